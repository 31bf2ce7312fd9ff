"""Collocations against a plain count of all phrases, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from compare import connect

from tillscope.llm import phrases
from tillscope.llm.queries import ORACLES, QUERIES


def _plain(rows, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", corpus.lower(text or "")):
            own = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(own)
            for k in (1, 2, 3):
                counts.update((lang, *own[n : n + k]) for n in range(len(own) - k + 1))
    found = defaultdict(list)
    candidates = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    longest = Counter()
    for (lang, *words), a in candidates.items():
        if len(words) == 3:
            for inner in ((lang, *words[:2]), (lang, *words[1:])):
                longest[inner] = max(longest[inner], a)
    for (lang, *words), a in candidates.items():
        if (lang, *words) in longest and 100 * longest[lang, *words] >= share * a:
            continue
        score, _, left, right = min(
            (1_000_000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k,
             counts[lang, *words[:k]], counts[lang, *words[k:]])
            for k in range(1, len(words))
        )
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)
    )


def _found(spark, rows, partitions=5, **kw):
    docs = spark.createDataFrame(
        [(lang, text, 1, 2, 3) for lang, text in rows], "lang string, text string, a int, n int, x int"
    )
    return sorted(map(tuple, phrases.collocations(docs.repartition(partitions), **kw).collect()))


def _rows(seed, n, words=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "a-b", "\x01c", "ÀB"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        own = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" "] * 8 + [". ", "\t", "\n", ";", "  "]) for w in own)
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    return rows + [("fr", None), (None, ""), ("fr", " .. \n")]


@pytest.mark.parametrize("least", (1, 2, 10))
def test_drawn_texts_equal_the_plain_version(spark, least):
    rows = _rows(least, 120)
    assert _found(spark, rows, least=least) == _plain(rows, least)


def test_ties_repeats_and_the_cut_of_the_report(spark):
    rows = [("en", "new york city. Old town, new york city; x y z")] * 12 + [("en", "p q")] * 12
    want = _plain(rows, top=3)
    assert _found(spark, rows, top=3) == want and len(want) == 3
    assert _found(spark, rows) == _plain(rows)


@pytest.mark.parametrize("chunk_words", (3, 13))
def test_chunks_may_end_anywhere(spark, chunk_words):
    """Phrases that span chunks are counted once, and words of the context not again."""
    rows = _rows(7, 60)
    assert _found(spark, rows, 1, least=2, chunk_words=chunk_words) == _plain(rows, 2)


def test_a_word_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(w for _ in range(40) for w in ("the", f"n{rng.randrange(300)}", "x"))) for _ in range(60)]
    assert _found(spark, rows, least=2) == _plain(rows, 2)


def test_an_empty_table(spark):
    assert _found(spark, [("en", None)]) == []
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).isEmpty()


def test_the_query_equals_its_sql(spark, data):
    found = QUERIES["op13_collocations"](spark, data)
    result = connect(data).execute(ORACLES["op13_collocations"])
    names = [d[0] for d in result.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in found.columns) for r in result.fetchall())
    assert sorted(map(tuple, found.collect())) == want and want


def test_many_buckets_give_the_same_counts(spark):
    """Runs of a few phrases, summed while a bucket is read, count the same."""
    rows = _rows(11, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    chunks = phrases.word_chunks(docs, 50)
    vocabulary = phrases.materialise(
        phrases.row_index(phrases.word_counts(chunks).where("n >= 2"), ["lang", "word"], "id")
    )
    few, many = (
        sorted(map(tuple, phrases._phrase_counts(chunks, vocabulary, 2, size).collect()))
        for size in (1 << 21, 4)
    )
    assert few == many and len(few) > 100


def test_a_run_keeps_its_phrases():
    head = np.array([1 << 32 | 5, 7 << 32 | 1, (1 << 62) + 3, 2], np.int64)  # pairs, then triples
    third = np.array([0, 0, 0, (1 << 31) - 1], np.int64)
    times = np.array([1, 1 << 20, 3, 4], np.int64)
    found = phrases._unblob(phrases._blob(head, third, times), 4)
    assert all((a == b).all() for a, b in zip(found, (head, third, times)))
