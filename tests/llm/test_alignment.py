"""Galloping intersection and the alignment query against plain versions."""

import bisect
import hashlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillscope.llm import alignment
from tillscope.llm.queries import tokenizer_path
from tillscope.llm.registry import table

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
rising = st.sets(st.integers(0, 3000), max_size=300).map(sorted)


@given(rising, rising)
def test_galloping_finds_every_rank(short, long):
    found = alignment.gallop(np.array(short, np.int64), np.array(long, np.int64))
    assert found.tolist() == [bisect.bisect_left(long, v) for v in short]


@given(rising, rising)
def test_overlaps_are_those_of_all_pairs(a, b):
    last = max([*a, *b, 0]) + 1
    a, b = [v + 1 for v in a] + [last + 1], [v + 1 for v in b] + [last + 1]
    cut = alignment.Overlaps(np.array(a), np.array(b))
    spans_a, spans_b = list(zip([0, *a], a)), list(zip([0, *b], b))
    want = {
        (i, j)
        for i, (s, e) in enumerate(spans_a)
        for j in range(bisect.bisect_right(b, s), len(b))
        if spans_b[j][0] < e
    }
    got = list(zip(cut.link_a.tolist(), cut.link_b.tolist()))
    assert len(got) == len(want) and set(got) == want
    common = sorted(set(a) & set(b))
    assert [a[i] for i in cut.last_a] == common == [b[i] for i in cut.last_b]


def _plain(rows):
    """The contract, token by token."""
    coder = Tokenizer.from_file(tokenizer_path(LEFT))
    coder.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(RIGHT))
    names = alignment.bpe.byte_names()
    aligned = []
    for doc_id, text in rows:
        whole = f" {text or ''}".encode()
        a = coder.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        spell_a = [bytes(names[c] for c in coder.id_to_token(i)) for i in a]
        spell_b = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in b)
        ]
        if not text or b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            aligned.append((doc_id, [], [], [], []))
            continue
        ends_a = np.cumsum([len(s) for s in spell_a]).tolist()
        ends_b = np.cumsum([len(s) for s in spell_b]).tolist()
        owner_a = [i for i, s in enumerate(spell_a) for _ in s]
        owner_b = [j for j, s in enumerate(spell_b) for _ in s]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        aligned.append((doc_id, a, b, groups, links))
    counts = Counter(link for *_, links in aligned for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (
            doc_id, len(a), len(b), len(groups), len(links),
            sum(counts[link] == most[link[1]] for link in links),
            sum(counts[link] for link in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, a, b, groups, links in aligned
    ]


def _key(row):
    return tuple((v is None, v or 0) for v in row[:1]) + tuple(row[1:])


def _found(spark, docs):
    rows = alignment.align(docs, tokenizer_path(LEFT), tokenizer_path(RIGHT)).collect()
    return sorted(map(_key, map(tuple, rows)))


def test_awkward_rows_equal_the_plain_version(spark, monkeypatch):
    rows = [
        *[r for r in corpus.ROWS if r[0] not in (12, 13, 14)],
        (20, "<|endoftext|> in a text, </s><unk> too"),
        (21, "one ▁ mark is no space"),
        (22, "\t tabs \n\n and\r\nlines   spaces  "),
        (23, "emoji 👩‍👩‍👧 ﷺ ﬁ ½ ②   zero​width ͸ Ⅷ"),
        (24, "x" * 3000 + " " * 3000 + "y"),
        (25, " "),
        (26, "﻿mark \x00 null \x1f unit"),
    ]
    want = sorted(map(_key, _plain(rows)))
    assert _found(spark, corpus.documents(spark, rows)) == want


def test_the_whole_table_equals_the_plain_version(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert _found(spark, docs) == sorted(map(_key, _plain(rows)))


def test_groups_and_counts_are_outputs(spark):
    docs = corpus.documents(spark, [(1, "hello world"), (2, "hello")])
    paths = tokenizer_path(LEFT), tokenizer_path(RIGHT)
    rows = alignment.align(docs, *paths, groups=True).collect()
    for row in rows:
        assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    counts = alignment.link_counts(alignment.aligned_chunks(docs, *paths)).collect()
    assert sum(r["n"] for r in counts) == sum(r["n_links"] for r in rows)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert _found(spark, docs) == []
