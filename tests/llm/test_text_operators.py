"""Quality rules, line dedup, SimHash and substring dedup against plain versions."""

import random

import corpus
import pytest
from pyspark.sql import functions as F

from tillscope.llm import line_dedup, quality_rules, simhash, substring_dedup
from tillscope.llm.components import connected_components
from tillscope.llm.quality_rules import Condition, DecisionList


def test_statistics_of_awkward_texts(spark):
    found = quality_rules.text_statistics(corpus.documents(spark)).select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "doc",
    )
    rows = found.collect()
    assert len(rows) == len(corpus.ROWS)
    for row in rows:
        want = corpus.statistics(row["text"])
        assert tuple(row[2:7]) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row["kept"] is True and row["doc"] == 1


def test_rules_are_learned_and_reject_only_what_they_cover(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        bad = n % 4 == 0
        rows.append(
            (n, bad, rng.randint(60, 900), 5.0, rng.uniform(0.5, 2) if bad else rng.uniform(0, 0.1),
             rng.random() / 5, rng.random() / 5)
        )
    columns = ", ".join(f"{f} double" for f in quality_rules.FEATURES[1:])
    stats = spark.createDataFrame(rows, f"_id long, bad boolean, n_words long, {columns}")
    rules = quality_rules.learn_rules(stats)
    assert rules.rules
    judged = stats.withColumn("keeps", rules.keeps()).collect()
    assert all(r["keeps"] != r["bad"] for r in judged)
    assert all(len(rule) <= 4 for rule in rules.rules)


def test_conditions_are_ordered_expressions(spark):
    rules = DecisionList(
        (
            (Condition("symbols_per_word", True, 0.5), Condition("n_words", False, 100.0)),
            (Condition("dup_line_share", True, 0.9),),
        )
    )
    frame = spark.createDataFrame(
        [(1.0, 50, 0.0), (1.0, 200, 0.0), (0.0, 50, 1.0)],
        "symbols_per_word double, n_words long, dup_line_share double",
    )
    assert [r[0] for r in frame.select(rules.keeps()).collect()] == [False, True, False]


def test_no_labels_give_no_rules(spark):
    docs = corpus.documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(quality_rules.labelled_statistics(docs, labels))
    assert rules == DecisionList(())
    judged = quality_rules.judge(docs, rules)
    assert judged.where("kept <> (NOT base_failed)").isEmpty()
    assert quality_rules.judge(docs.limit(0), rules).isEmpty()


def test_line_dedup(spark):
    kept = line_dedup.dedup_lines(corpus.documents(spark))
    assert set(corpus.documents(spark).columns) <= set(kept.columns)
    key = lambda r: (str(r[0]), str(r[1]))
    rows = sorted(
        (tuple(r) for r in kept.select("doc_id", "text", "n_lines", "n_dropped", "kept_text").collect()),
        key=key,
    )
    want = sorted(
        ((*row, *out) for row, out in zip(corpus.ROWS, corpus.deduped_lines(corpus.ROWS))), key=key
    )
    assert rows == want


def test_line_dedup_splits_a_hot_line(spark, monkeypatch):
    rows = [(n, f"a line that every document holds\nown line number {n}") for n in range(500)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    hot = line_dedup.hot_hashes(line_dedup.line_hashes(docs)).count()
    assert hot == 1
    kept = line_dedup.dedup_lines(docs)
    assert kept.agg(F.sum("n_dropped")).first()[0] == 499
    assert line_dedup.dedup_lines(docs.limit(0)).isEmpty()


def test_fingerprints_and_components(spark):
    found = simhash.near_duplicates(corpus.documents(spark), width=3).collect()
    assert len(found) == len(corpus.ROWS)
    values = sorted({corpus.fingerprint(text, 3) for _, text in corpus.ROWS})
    group = dict(
        zip(values, corpus.components(values, lambda a, b: (a ^ b).bit_count() <= 3))
    )
    least = {}
    for doc_id, text in corpus.ROWS:
        g = group[corpus.fingerprint(text, 3)]
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    want = sorted(
        str((doc_id, corpus.fingerprint(text, 3), least.get(group[corpus.fingerprint(text, 3)])))
        for doc_id, text in corpus.ROWS
    )
    assert sorted(str((r[0], r[1] % (1 << 64), r[2])) for r in found) == want
    assert simhash.near_duplicates(corpus.documents(spark).limit(0), 3).isEmpty()


@pytest.mark.parametrize("crowd", [4, 256])
def test_links_connect_what_is_close(spark, crowd):
    rng = random.Random(3)
    base, values = rng.getrandbits(64), set()
    for _ in range(150):
        value = base
        for _ in range(rng.randint(0, 9)):
            value ^= 1 << rng.choice([0, 2, 5, 8, 13, 21, 31, 32, 45, 50, 63])
        values.add(value)
    values = sorted(values | {rng.getrandbits(64) for _ in range(20)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = corpus.components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {(roots.get(v, v), g) for v, g in zip(signed, want)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(30)] + [(100, n) for n in range(101, 140)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert roots == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_one_document_of_a_group_stays(spark):
    base = [f"w{n}" for n in range(200)]
    near = base[:90] + ["changed"] + base[91:]
    far = base[:100] + [f"v{n}" for n in range(100)]
    rows = [(n, " ".join(t)) for n, t in ((5, base), (6, base), (7, near), (8, far), (None, base))]
    rows += [(9, None), (20, ""), (21, "other text"), (21, "other text")]
    docs = corpus.documents(spark, rows)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 8, 9, 21]
    assert simhash.keep_representatives(docs.limit(0)).isEmpty()


def _passage(tag):
    return " ".join(f"{tag}{n}" for n in range(60)) + "."


def test_repeated_passage_is_removed_and_offsets_hold(spark):
    rows = [
        (1, f"First text. {_passage('p')} Then it ends here."),
        (2, f"Second text, with more words. {_passage('p')} And something else."),
        (3, f"Clean text. {_passage('q')} Nothing shared."),
        (4, f"Twice here. {_passage('r')} {_passage('r')}"),
        (None, _passage("p")),
        (5, None),
        (6, ""),
        (7, "short. short. short."),
    ]
    docs = corpus.documents(spark, rows)
    texts = dict(rows)
    spans = substring_dedup.removed_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == {2, 4, None}
    for row in spans:
        cut = texts[row["doc_id"]][row["start"] : row["end"]]
        assert len(cut.split()) >= substring_dedup.UNIT_WORDS
        assert cut in texts[row["kept_doc_id"]]
    kept = substring_dedup.remove_spans(docs)
    assert kept.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {k: after[k] for k in (1, 3, 5, 6, 7)} == {k: texts[k] for k in (1, 3, 5, 6, 7)}
    for row in spans:
        text = texts[row["doc_id"]]
        assert after[row["doc_id"]] == text[: row["start"]] + text[row["end"] :]
    assert substring_dedup.remove_spans(docs.limit(0)).isEmpty()


def test_substring_dedup_of_awkward_rows(spark):
    docs = corpus.documents(spark)
    kept = substring_dedup.remove_spans(docs)
    assert kept.count() == len(corpus.ROWS)
    flagged = {r["doc_id"] for r in substring_dedup.removed_spans(docs).collect()}
    assert {2, 3, None} <= flagged and 1 not in flagged
