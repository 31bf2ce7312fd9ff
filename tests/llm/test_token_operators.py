"""BPE, packing, token counts, WARC, top-k and toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import bpe, packing, token_counts, topk, toxicity, warc
from tillscope.llm.queries import tokenizer_path
from tillscope.session import materialise, scratch_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = [
    "a", "e", "th", "in", "ing", " ", "  ", "\n", ".", "é", "ß", "日", "語", "՘", "\U0001e900",
    "1", "23", "<|endoftext|>", "<|startoftext|>", "\x1c", "\xa0", "'s", "'", "----", "\t", "​",
    "🙂", "é", "İ", "Σ",
]


def mixed(rng, longest=60):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest)))


@pytest.fixture(scope="module")
def coder():
    return bpe.Transducer(tokenizer_path(BYTE_BPE))


def test_bpe_equals_the_library(coder):
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    rng = random.Random(5)
    texts = [mixed(rng) for _ in range(800)]
    for alphabet in (["-"], ["a", "b"], ["t", "h", "e", "i", "n"], ["ab", "ra", "the", "ing"], [" "]):
        texts.append("".join(rng.choice(alphabet) for _ in range(5000)))
    for text in texts:
        ids = np.frombuffer(b"".join(coder.encode(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoded = "".join(coder.decode(coder.encode(text)))
        assert decoded == library.decode(ids, skip_special_tokens=False) == text


def test_windows_of_any_size_give_the_same_tokens(coder):
    rng = random.Random(1)
    piece = "".join(rng.choice("theinanored") for _ in range(4000)).encode()
    whole = coder.merges.merge(piece)
    for block in (1, 200, 999):
        assert [t for part in coder.merges.stream(piece, block) for t in part] == whole


def test_decoding_replaces_broken_bytes(coder):
    tokens = [coder.merges.byte_ids[b] for b in b"\xe6\x97ok\xff"]
    blocks = [bpe._packed([t]) for t in tokens]
    assert "".join(coder.decode(iter(blocks))) == b"\xe6\x97ok\xff".decode(errors="replace")


def test_transduce_whole_rows(spark):
    docs = corpus.documents(spark)
    rows = bpe.transduce(docs, tokenizer_path(BYTE_BPE), ids=True, decoded=True).collect()
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    want = []
    for doc_id, text in corpus.ROWS:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest, ids, text or ""))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.transduce(docs.limit(0), tokenizer_path(BYTE_BPE)).isEmpty()


def _fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(n, bins):
        if len(bins) >= best[0]:
            return
        if n == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k, room in enumerate(bins):
            if room >= items[n] and room not in tried:
                tried.add(room)
                bins[k] -= items[n]
                place(n + 1, bins)
                bins[k] += items[n]
        place(n + 1, [*bins, capacity - items[n]])

    place(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    rng = random.Random(2)
    for _ in range(250):
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + _fewest(left, 20) == _fewest(items, 20)


def test_plans_use_every_piece_once_and_near_the_bound():
    rng = random.Random(4)
    for size, capacity in ((0, 30), (40, 30), (5000, 2048)):
        counts = Counter(rng.randint(1, capacity) for _ in range(size))
        plan = packing.pack_histogram(dict(counts), capacity)
        used = Counter()
        for pattern, bins in plan:
            assert sum(s * n for s, n in pattern) <= capacity
            for s, n in pattern:
                used[s] += n * bins
        assert used == counts
        bound = math.ceil(sum(counts.elements()) / capacity)
        assert bound <= sum(bins for _, bins in plan) <= 1.1 * bound + 2


def test_packed_documents(spark):
    docs = corpus.documents(spark)
    rows = packing.pack_documents(docs, tokenizer_path(WORD_BPE)).collect()
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    want = []
    for doc_id, text in corpus.ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want.append((doc_id, piece, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(str, (tuple(r[:5]) for r in rows))) == sorted(map(str, want))
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / 2048) + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path(WORD_BPE)).isEmpty()


def test_runs_have_the_ids_of_the_whole_text():
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    words = packing.WordCoder(tokenizer_path(WORD_BPE))
    rng = random.Random(8)
    for _ in range(800):
        text = mixed(rng, 40)
        ids = np.frombuffer(words.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark):
    docs = corpus.documents(spark)
    rows = token_counts.count_tokens(docs, tokenizer_path(WORD_BPE), 49407).collect()
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    library.encode_special_tokens = True
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus.ROWS]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path(WORD_BPE), 49407).isEmpty()


def test_documents_across_blocks_are_stitched(spark, tmp_path):
    rng = np.random.default_rng(3)
    files, want = [], []
    for name, closed in (("a", True), ("b", False), ("c", True)):
        lengths = [0, 0, 17, 1, 0, 40, 3, *rng.integers(0, 9, 30).tolist(), 0]
        ids, start = [], 0
        for number, length in enumerate(lengths):
            want.append((name, number, start, length))
            ids += [*rng.integers(1, 9, length).tolist(), 0]
            start += length + 1
        if not closed:  # the last document has tokens and no end
            ids += [5, 5, 5]
            want.append((name, len(lengths), start, 3))
        path = tmp_path / name
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((f"file://{path}", path.stat().st_size))
    table = spark.createDataFrame(files, "path string, bytes long")
    for block in (1, 4, 7, 10_000):
        scanned = token_counts.scan_blocks(table, 0, "<u2", block)
        found = token_counts.stitch(scanned).collect()
        assert sorted((r[0].rpartition("/")[2], *r[1:]) for r in found) == sorted(want)


PAGES = [
    (5, "http://a/", "x" * 200), (3, "http://b/", "x" * 200), (9, None, "x" * 200), (1, "u", "short"),
    (2, "u", "short"), (4, "line\nbreak\r", None), (6, "", ""), (7, "u", "é" * 50), (8, "u", "é" * 50),
    (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "q" * 300_000), (None, "u", "x" * 200),
    (3, "http://b/", "x" * 200),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(
        [(*p, "extra", 1) for p in PAGES],
        "page_id long, url string, html string, payload string, digest int",
    )
    rows = warc.archive_pages(pages).collect()
    first = {"x" * 200: 3, "é" * 50: 7, "q" * 300_000: 12}
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        revisit = html in first and first[html] != page_id
        want.append(
            (page_id, "revisit" if revisit else "response", None if revisit else body, len(body),
             hashlib.sha256(body).hexdigest(), first[html] if revisit else None)
        )
    found = [
        (r["page_id"], r["record_type"], None if r["payload"] is None else bytes(r["payload"]),
         r["payload_bytes"], r["payload_digest"], r["refers_to"])
        for r in rows
    ]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert {r["url"] for r in rows} == {"http://a/", "http://b/", None, "u", "linebreak"}
    assert warc.archive_pages(pages.limit(0)).isEmpty()


def test_small_archives_and_broken_ones(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(warc.mark_revisits(pages), folder, max_bytes=600)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    assert manifest.count() >= 5
    body = b"payload " * 40
    whole = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), "response", None, "2024")
    text = zlib.decompress(whole, 31)

    def read(data):
        path = tmp_path / "one.warc.gz"
        path.write_bytes(data)
        return warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()

    assert bytes(read(whole * 3)[2]["payload"]) == body
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    for broken in (
        whole[:-9],
        packed.compress(text.replace(b"payload payload", b"payload paylord")) + packed.flush(),
    ):
        with pytest.raises(Exception, match="digest differs|ends within"):
            read(broken)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(n, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for n in range(120)]
    rows += [(100, [0.5] * 8), (100, [0.5] * 8), (None, [0.5] * 8), (200, []), (201, None)]
    rows += [(202, [None, 1.0]), (203, [float("nan")] * 8), (204, [float("inf")]), (250, [1.0, -0.001])]
    rows += [(300 + n, [0.5] * 8) for n in range(40)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "vec_id long, embedding array<double>, rid int, score string")
    valid = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for n, (i, v) in enumerate(valid):
        if i is not None and i % 50 == 0:
            scored = [
                (-sum(a * b for a, b in zip(v, w)), j is None, j or 0)
                for m, (j, w) in enumerate(valid)
                if m != n
            ]
            for rank, (score, null, j) in enumerate(sorted(scored)[:5], 1):
                want.append((i, rank, None if null else j, -score))
    for blocks in ({}, {"query_rows": 2, "candidate_rows": 30}):
        found = topk.top_k(table, **blocks).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert topk.top_k(table.limit(0)).isEmpty()
    few = topk.top_k(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def _labelled(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for doc_id in range(n):
        toxic = int(rng.random() < 0.3)
        own = [f"w{rng.randrange(300)}" for _ in range(40)]
        own = ["word" + "abcdefghij"[int(w[-1])] + w for w in own]
        if toxic and rng.random() < 0.9:
            own[3] = rng.choice(["nastyish", "nastyest", "awful"])
        # In the sample, naming a group goes along with toxicity.
        if rng.random() < (0.8 if toxic else 0.1):
            own[7] = rng.choice(["muslims", "christians", "jews"])
        rows.append((doc_id, " ".join(own)))
        labels.append((doc_id, 1, toxic))
    return corpus.documents(spark, rows), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_toxicity_held_out_and_counterfactual(spark):
    docs, labels = _labelled(spark)
    docs, labels = materialise(docs), materialise(labels)
    fair = toxicity.train(docs, labels, fairness=30.0)
    blunt = toxicity.train(docs, labels, fairness=0.0)
    neutral, other = "wordc are muslims wordd", "wordc are hindus wordd"

    def gap(model):
        return abs(model.score(neutral) - model.score(other))

    assert gap(fair) < 0.5 * gap(blunt)
    found = toxicity.score(docs, fair).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert right >= 0.85 * len(found) > 60
    for row in found[:20]:
        assert zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)


def test_neutral_mentions_are_not_toxic_with_the_penalty(spark):
    docs, labels = _labelled(spark)
    docs, labels = materialise(docs), materialise(labels)
    fair = toxicity.train(docs, labels, fairness=30.0)
    blunt = toxicity.train(docs, labels, fairness=0.0)
    assert fair.swapped > 0 and fair.slotted > 0
    held = [r["text"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()]
    clean = [t for t in held if not toxicity.words_of(t) & {"nastyish", "nastyest", "awful"}]
    before = after = 0
    for text in clean:
        rest = [w for w in text.split() if w not in ("muslims", "christians", "jews")]
        mention = " ".join([*rest, "muslims"])
        assert fair.score(mention) < blunt.score(mention)
        before += blunt.score(mention) >= 0.5
        after += fair.score(mention) >= 0.5
    assert after < before


def test_slots_act_where_no_text_names_a_group(spark):
    rows = [(n, "chr" + "istmas dinner" if n % 3 else "dull evening") for n in range(90)]
    docs = corpus.documents(spark, rows)
    labels = spark.createDataFrame(
        [(n, 1, int(n % 3 > 0)) for n in range(90)], "doc_id long, quality int, toxic int"
    )
    # "christmas" shares its beginning with "christians", which no text holds.
    sets = (("christians", "jews"),)
    blunt = toxicity.train(docs, labels, fairness=0.0, terms=sets)
    fair = toxicity.train(docs, labels, fairness=30.0, terms=sets)
    assert fair.swapped == 0 and fair.slotted > 0

    def change(model):
        return abs(model.word_weight("christians"))

    assert change(fair) < 0.2 * change(blunt)
    assert toxicity.train(docs, labels, terms=()).slotted == 0


def test_slots_take_terms_that_the_text_does_not_name():
    sets = (("women", "men"), ("old", "young"), ("alone",))
    seen = set()
    for n in range(200):
        swaps, slots = toxicity.copy_differences(f"text {n}", {"text"}, sets, sets)
        assert not swaps and slots[0][0] is None
        term = slots[0][1]
        group = next(g for g in sets if term in g)
        assert [s for s in slots[1:]] == ([] if len(group) == 1 else [(term, *set(group) - {term})])
        seen.add(term)
    assert seen == {"women", "men", "old", "young", "alone"}
    swaps, slots = toxicity.copy_differences("women", {"women"}, sets[:1], sets[:1])
    assert swaps == [("women", "men")] and not slots
    assert toxicity.copy_differences("", set(), sets, ()) == ([], [])


def test_held_out_labels_are_never_read(spark):
    docs, labels = _labelled(spark, 200)
    flipped = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_of_awkward_rows(spark):
    docs = corpus.documents(spark)
    none = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(corpus.ROWS)
    assert all(r["score"] == 0.5 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.score(docs.limit(0), model).isEmpty()


def test_swaps_name_other_members_of_a_set():
    swaps = toxicity.counterfactuals({"women", "walk"})
    assert swaps == [("women", "men"), ("women", "girls"), ("women", "boys")]
