"""Alignment of two tokenizers by galloping intersection of their token ends.

Both tokenizers spell out the same bytes. Offsets where tokens of both end cut the
tokens into groups: the shorter list of ends drives an exponential, then binary
search into the longer one. The ranks found also say which tokens overlap: a token
meets those from the rank after the previous end up to the rank of its own end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import bpe
from tillscope.llm.chunks import chunk_id, entries, squeezed, unsqueezed, written
from tillscope.llm.columns import apart
from tillscope.session import materialise, ship_package

_CHUNK_CHARS = 1 << 21
_STRIDE = 16
# The fast encoder takes texts of settled character classes without endless runs.
_FOR_LIBRARY = regex.compile(rf"{bpe._UNSETTLED.pattern}|\S{{1000}}|\s{{1000}}")


class ByteCoder:
    """Byte-level BPE from a ``tokenizer.json`` file; special strings are plain text."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = bpe.byte_names()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        raw = {
            i: token.encode() if token in special else bytes(names[c] for c in token)
            for token, i in self.library.get_vocab(with_added_tokens=True).items()
        }
        self.bytes_of = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.fast = None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"][a + b] for a, b in pairs]
        if made == sorted(made):  # ids rise with the rank of their merge
            ranks = {raw[i]: i for token, i in model["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=bpe._PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _FOR_LIBRARY.search(text) is not None:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceCoder:
    """A sentencepiece model, with the bytes of each piece."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            of_byte = self.library.is_byte(i)
            self.bytes_of.append(
                bytes([int(piece[3:5], 16)]) if of_byte else piece.replace("▁", " ").encode()
            )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class _Pair:
    """Both coders and the tables that follow from their vocabularies."""

    def __init__(self, left: str, right: str) -> None:
        self.left, self.right = ByteCoder(left), PieceCoder(right)
        self.sizes = [
            np.array([len(b) for b in c.bytes_of], np.int64) for c in (self.left, self.right)
        ]
        n, m = map(len, self.sizes)
        self.words = [
            f"{i}{mark}".encode() for count, marks in ((n, ",|"), (m, ",;")) for mark in marks
            for i in range(count)
        ]
        self.bases = (n, 2 * n, m)


_LOADED: dict[tuple[str, str], _Pair] = {}


def _pair(left: str, right: str) -> _Pair:
    if (left, right) not in _LOADED:
        _LOADED[left, right] = _Pair(left, right)
    return _LOADED[left, right]


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of the rising ``short``, the rank of the first in ``long`` not below it.

    Every 16th value is looked up first, the same way. From its rank on the values
    behind it step ahead by 1, 2, 4, ... until they pass their place, and halve the
    last step. All values of a level step together.
    """
    n = len(long)
    if len(short) <= _STRIDE:
        low = np.zeros(len(short), np.int64)
    else:
        low = np.repeat(gallop(short[::_STRIDE], long), _STRIDE)[: len(short)]
    padded = np.append(long, np.iinfo(np.int64).max)
    high = low.copy()
    going, step = np.flatnonzero(padded[low] < short), 1
    low[going] += 1
    while len(going):
        probe = np.minimum(low[going] + step - 1, n)
        below = padded[probe] < short[going]
        high[going] = probe
        going = going[below]
        low[going] = probe[below] + 1
        step *= 2
    high = np.maximum(high, low)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = padded[middle] < short[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


class Overlaps:
    """Groups and links of two rising lists of ends with the same last value."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        turned = len(ends_b) < len(ends_a)
        short, long = (ends_b, ends_a) if turned else (ends_a, ends_b)
        rank = gallop(short, long)
        common = long[rank] == short if len(short) else np.zeros(0, bool)
        last_short, last_long = np.flatnonzero(common), rank[common]
        first = np.concatenate(([0], rank[:-1] + common[:-1])) if len(rank) else rank
        counts = rank - first + 1
        from_short = np.repeat(np.arange(len(short)), counts)
        starts = np.cumsum(counts) - counts
        from_long = np.arange(len(from_short)) - np.repeat(starts - first, counts)
        if turned:
            last_short, last_long = last_long, last_short
            from_short, from_long = from_long, from_short
        # Ranks of the last tokens of each group, and of the tokens of each link.
        self.last_a, self.last_b = last_short, last_long
        self.link_a, self.link_b = from_short, from_long


def _spelled(pair: _Pair, ids_a: np.ndarray, ids_b: np.ndarray, cut: Overlaps) -> list[bytes]:
    """Decimal ids with what follows each, in the order A then B of each group."""
    n, m = len(ids_a), len(ids_b)
    group_a = np.zeros(n, np.int64)
    group_a[cut.last_a[:-1] + 1] = 1
    group_b = np.zeros(m, np.int64)
    group_b[cut.last_b[:-1] + 1] = 1
    before_b = np.concatenate(([0], cut.last_b[:-1] + 1))
    place_a = np.arange(n) + before_b[np.cumsum(group_a)]
    place_b = np.arange(m) + (cut.last_a + 1)[np.cumsum(group_b)]
    code_a, code_b = ids_a.copy(), ids_b + pair.bases[1]
    code_a[cut.last_a] += pair.bases[0]
    code_b[cut.last_b] += pair.bases[2]
    codes = np.empty(n + m, np.int64)
    codes[place_a], codes[place_b] = code_a, code_b
    return list(map(pair.words.__getitem__, codes.tolist()))


_DOCS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _aligned(pair: _Pair, ids: list, texts: list[str], chunk: int, groups: bool) -> pa.RecordBatch:
    """One row for a chunk of documents: dictionary of links, and what is per document."""
    found_a, found_b, used = [], [], []
    spoken = pair.right.encode([t or "" for t in texts])
    for n, (text, right) in enumerate(zip(texts, spoken)):
        if text:
            whole = f" {text}"
            left, data = pair.left.encode(whole), whole.encode("utf-8", "surrogatepass")
            if (
                b"".join(map(pair.left.bytes_of.__getitem__, left)) == data
                and b"".join(map(pair.right.bytes_of.__getitem__, right)) == data
            ):
                found_a.append(np.array(left, np.int64))
                found_b.append(np.array(right, np.int64))
                used.append(n)
    none = [np.zeros(0, np.int64)]
    ids_a, ids_b = np.concatenate(found_a or none), np.concatenate(found_b or none)
    # Both lists spell the same bytes document by document: one search does for all.
    cut = Overlaps(np.cumsum(pair.sizes[0][ids_a]), np.cumsum(pair.sizes[1][ids_b]))
    keys = (ids_a[cut.link_a] << 32) | ids_b[cut.link_b]
    pairs, where, times = np.unique(keys, return_inverse=True, return_counts=True)
    until_a = np.cumsum([len(x) for x in found_a], dtype=np.int64)
    until_b = np.cumsum([len(x) for x in found_b], dtype=np.int64)
    until_group = np.searchsorted(cut.last_a, until_a)
    until_link = np.searchsorted(cut.link_a, until_a)
    words = _spelled(pair, ids_a, ids_b, cut) if used else []
    columns = {
        "doc_id": ids,
        **{c: np.zeros(len(texts), np.int64) for c in _DOCS[1:5]},
        "groups_sha256": [""] * len(texts),
    }
    spelled = [""] * len(texts)
    for name, until in zip(_DOCS[1:5], (until_a, until_b, until_group, until_link)):
        columns[name][used] = np.diff(until, prepend=0)
    for n, end in zip(used, (until_a + until_b).tolist()):
        text = b"".join(words[end - columns["n_a"][n] - columns["n_b"][n] : end])[:-1]
        columns["groups_sha256"][n] = hashlib.sha256(text).hexdigest()
        if groups:
            spelled[n] = text.decode()
    # Per document its distinct links with their counts, as one rising list.
    held = np.repeat(np.array(used, np.int64), np.diff(until_link, prepend=0))
    held, often = np.unique(held * max(1, len(pairs)) + where, return_counts=True)
    rows = {
        "chunk": pa.array([chunk], pa.int64()),
        "pair": pa.array([pairs], pa.list_(pa.int64())),
        "times": pa.array([times], pa.list_(pa.int64())),
        "n_held": pa.array([len(held)], pa.int64()),
        "n_pairs": pa.array([len(pairs)], pa.int64()),
        "held": pa.array([squeezed(np.diff(held, prepend=0).astype("<i4"))], pa.binary()),
        "often": pa.array([squeezed(often.astype("<i4"))], pa.binary()),
        **{
            c: pa.array([v], pa.list_(pa.string() if c == "groups_sha256" else pa.int64()))
            for c, v in columns.items()
        },
        "groups": pa.array([spelled if groups else None], pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_pydict(rows)


_CHUNK = (
    "chunk long, pair array<long>, times array<long>, n_held long, n_pairs long, held binary, "
    "often binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, groups array<string>"
)


def aligned_chunks(docs: DataFrame, left: str, right: str, groups: bool = False) -> DataFrame:
    """Chunks of ``docs(doc_id, text)`` with their links, written to the shared folder."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = _pair(left, right), 0
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "") + 64
                if held >= _CHUNK_CHARS:
                    yield _aligned(pair, ids, texts, chunk_id(n), groups)
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield _aligned(pair, ids, texts, chunk_id(n), groups)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, _CHUNK), "aligned")


def link_counts(chunks: DataFrame) -> DataFrame:
    """``(pair, a, b, n, best)``: how often two ids are linked; is it the most for ``b``."""
    counts = materialise(
        entries(chunks, "pair", "times").groupBy("pair").agg(F.sum("times").alias("n"))
    ).select(
        "pair",
        F.shiftright("pair", 32).alias("a"),
        F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"),
        "n",
    )
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    most = most.select(apart(F.col("b")).alias("_b"), "most")
    return counts.join(most, F.col("b") == F.col("_b")).select(
        "pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")
    )


def align(docs: DataFrame, left: str, right: str, groups: bool = False) -> DataFrame:
    """Align a byte-level and a sentencepiece tokenizer over ``docs(doc_id, text)``.

    Both spell a space and the text. Per row: doc_id, the numbers of tokens
    ``n_a`` and ``n_b``, ``n_groups`` between common ends, ``n_links`` of overlapping
    tokens, ``n_best`` of them whose pair of ids is the most frequent of its b id in
    the corpus, ``count_sum`` of the corpus counts of all links, ``groups_sha256`` of
    the groups as ``a1,a2|b1;...`` and, on request, that text (``groups``).
    ``link_counts`` of ``aligned_chunks`` gives the corpus counts themselves.

    A null or empty text, or one that either tokenizer does not spell exactly, has
    no tokens: zeros and an empty string. Repeated rows and null ids are documents
    of their own; other columns are dropped; an empty table gives no rows.
    """
    chunks = aligned_chunks(docs, left, right, groups)
    counts = link_counts(chunks).select(apart(F.col("pair")).alias("_pair"), "n", "best")
    known = (
        entries(chunks, "pair")
        .join(counts, F.col("pair") == F.col("_pair"))
        .select(F.col("chunk").alias("of"), "at", "n", "best")
    )
    names = [*_DOCS[:5], "n_best", "count_sum", "groups_sha256", *["groups"] * groups]

    def run(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        row = {c: left_rows.column(c)[0] for c in left_rows.column_names}
        out = {c: row[c].values for c in [*_DOCS, *["groups"] * groups]}
        total, width = len(out["doc_id"]), max(1, row["n_pairs"].as_py())
        at = right_rows.column("at").to_numpy()
        n, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
        n[at] = right_rows.column("n").to_numpy()
        best[at] = right_rows.column("best").to_numpy()
        size = row["n_held"].as_py()
        held = np.cumsum(unsqueezed(row["held"].as_py(), size, "<i4"), dtype=np.int64)
        often = unsqueezed(row["often"].as_py(), size, "<i4").astype(np.int64)
        which = held % width
        ends = np.searchsorted(held, np.arange(1, total + 1) * width)
        for name, value in (("n_best", best), ("count_sum", n)):
            sums = np.concatenate(([0], np.cumsum(value[which] * often)))
            out[name] = pa.array(np.diff(sums[ends], prepend=0), pa.int64())
        return pa.table({c: out[c] for c in names})

    schema = ", ".join(
        f"{c} {'string' if c.startswith('groups') else 'long'}" for c in names
    )
    return (
        chunks.drop("pair", "times")
        .groupBy("chunk")
        .cogroup(known.groupBy("of"))
        .applyInArrow(run, schema)
    )
