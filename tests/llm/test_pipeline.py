"""Every stage of the pipeline on the smallest tables, held against plain versions."""

import math
from collections import defaultdict

import corpus
import corpus_pipeline
import pytest

from tillscope.llm.registry import table
from tillscope.session import scratch_path


@pytest.fixture(scope="module")
def stages(spark, data):
    """Input and output rows of each stage, by name."""
    docs, out = table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = scratch_path(spark, "pipeline-test")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == table(spark, data, "documents").columns
        out[name] = (before.collect(), docs.collect())
    return out


def _texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_keeps_clean_documents(spark, data, stages):
    before, after = map(_texts, stages["quality_rules"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, data, "labels").collect()}
    kept = set(after)
    for doc_id, text in before.items():
        n_words, *_, repeated = corpus.statistics(text)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            assert doc_id not in kept
        elif labels.get(doc_id) == 1:
            assert doc_id in kept
    assert {i: before[i] for i in kept} == after


def test_line_dedup_equals_the_plain_version(stages):
    before, after = stages["line_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    want = {row[0]: kept for row, (_, _, kept) in zip(rows, corpus.deduped_lines(rows))}
    assert _texts(after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != _texts(before)[r["doc_id"]])


def test_near_duplicates_leave_one_each_and_only_they_go(stages):
    before, after = map(_texts, stages["simhash_near_dedup"])
    ids = sorted(before)
    prints = [corpus.fingerprint(before[i], 3) for i in ids]
    least = {}
    for doc_id, root in zip(ids, corpus.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)):
        least.setdefault(root, doc_id)
    assert after == {i: before[i] for i in least.values()}


def test_passages_are_cut_out_of_later_documents(stages):
    before, after = map(_texts, stages["substring_dedup"])
    assert before.keys() == after.keys()
    windows = defaultdict(set)
    for doc_id, text in before.items():
        words = text.lower().split()
        for n in range(len(words) - 24):
            windows[tuple(words[n : n + 25])].add(doc_id)
    shared = {i for ids in windows.values() if len(ids) > 1 for i in ids if i > min(ids)}
    twice = set()
    for doc_id, text in before.items():
        words = text.lower().split()
        own = [tuple(words[n : n + 25]) for n in range(len(words) - 24)]
        if len(set(own)) < len(own):
            twice.add(doc_id)
    changed = {i for i in before if before[i] != after[i]}
    assert changed <= shared | twice


def test_all_pieces_are_packed(stages):
    before, after = stages["best_fit_packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    fill = defaultdict(int)
    for row in after:
        fill[row["sequence_id"]] += row["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= math.ceil(sum(fill.values()) / 2048) * 1.02 + 1


def test_run_gives_the_rows_of_the_last_stage(spark, data, stages):
    found = corpus_pipeline.run(spark, data).select("doc_id", "piece", "length", "ids_crc32")
    want = [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages["best_fit_packing"][1]]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_an_empty_table_passes_every_stage(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, data)
        assert result.isEmpty()
        docs = result if result.columns == docs.columns else docs


def test_awkward_rows_pass_every_stage(spark, data):
    """Null ids and texts, repeated rows, long texts, extra columns that clash."""
    docs = corpus.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "pipeline-test")
        stage(spark, docs, data).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns, name
        assert after.exceptAll(docs).select("doc_id").isEmpty() or name.endswith("dedup")
        docs = after
    assert not corpus_pipeline.STAGES[-1][1](spark, docs, data).isEmpty()
