"""Every id lies in one piece, sequences are full, and few documents are cut."""

import zlib
from collections import defaultdict

import corpus
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillscope.llm import online_packing
from tillscope.llm.online_packing import OpenWindows, Piece
from tillscope.llm.queries import tokenizer_path
from tillscope.llm.registry import table

PATH = "word_bpe_49k.json"


@given(st.lists(st.integers(1, 70), max_size=200), st.integers(1, 6))
def test_windows_keep_every_id_and_stay_bounded(sizes, limit):
    windows, made = OpenWindows(32, limit), []
    for n, size in enumerate(sizes):
        ids = b"".join((1000 * n + k).to_bytes(4, "little") for k in range(size))
        made += windows.offer(Piece(n, 0, ids, size))
        assert len(windows.rooms) == len(windows.held) <= limit
        assert all(0 < room <= 32 for room in windows.rooms)
    assert all(sum(len(p.ids) for p in s) == 128 for s in made)
    rest = list(windows.close())
    fill = [sum(len(p.ids) for p in s) // 4 for s in rest]
    assert all(f == 32 for f in fill[: sum(f == 32 for f in fill)])
    assert all(f & (f - 1) == 0 for f in fill) and len(set(fill) - {32}) == len([f for f in fill if f < 32])
    got = defaultdict(dict)
    for sequence in made + rest:
        for p in sequence:
            got[p.doc_id][p.start] = p.ids
    for n, size in enumerate(sizes):
        joined = b"".join(got[n][k] for k in sorted(got[n]))
        assert joined == b"".join((1000 * n + k).to_bytes(4, "little") for k in range(size))


def test_a_piece_goes_where_it_leaves_least_room():
    windows = OpenWindows(16, 3)
    for n, size in enumerate((9, 10, 12)):
        assert not list(windows.offer(Piece(n, 0, bytes(4 * size), size)))
    assert not list(windows.offer(Piece(3, 0, bytes(4 * 5), 5)))
    assert sorted(windows.rooms) == [1, 4, 7]
    (full,) = windows.offer(Piece(4, 0, bytes(4 * 9), 9))  # fits none: the fullest is filled up
    assert sum(len(p.ids) for p in full) == 64 and sorted(windows.rooms) == [4, 7, 8]


def _check(spark, docs, rows, capacity, limit=4):
    coder = Tokenizer.from_file(tokenizer_path(PATH))
    coder.no_truncation()
    coder.no_padding()
    found = online_packing.pack_online(docs, tokenizer_path(PATH), 2, capacity, limit).collect()
    wanted = defaultdict(list)
    for doc_id, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[doc_id].append(ids)
    held = defaultdict(list)
    for r in found:
        held[r["doc_id"]].append(r)
    assert held.keys() == wanted.keys()
    for doc_id, copies in wanted.items():
        pieces = sorted((r["start"], r["length"]) for r in held[doc_id])
        if len(copies) == 1:
            ids, at = copies[0], 0
            for r in sorted(held[doc_id], key=lambda r: r["start"]):
                own = ids[r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and len(own) == r["length"] > 0
                packed = b"".join(i.to_bytes(4, "little") for i in own)
                assert r["ids_crc32"] == zlib.crc32(packed) and r["doc_tokens"] == len(ids)
                at += len(own)
            assert at == len(ids)
        assert sum(n for _, n in pieces) == sum(map(len, copies))
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    partly = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        partly += [at] * (at < capacity)
    # No sequence needs padding.
    assert all(n & (n - 1) == 0 for n in partly) and len(set(partly)) == len(partly)
    return found


def test_awkward_rows(spark):
    _check(spark, corpus.documents(spark), corpus.ROWS, 64)
    _check(spark, corpus.documents(spark).repartition(7), corpus.ROWS, 4096, 1)


def test_the_whole_table_over_many_tasks(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # More tasks than one merge takes: several levels.
    found = _check(spark, docs.repartition(70), rows, 4096)
    cut = sum(r["length"] < r["doc_tokens"] <= 4096 for r in found)
    assert cut <= 3 * len({r["sequence_id"] for r in found})


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = online_packing.pack_online(docs, tokenizer_path(PATH), 2)
    assert found.isEmpty() and "sequence_id" in found.columns
