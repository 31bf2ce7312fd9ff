"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

The instance is its histogram of piece lengths: at most ``capacity`` rows, however
many documents there are. It is packed there, in whole groups of equal bins, and
the plan is applied to the pieces by their rank within a length. Reduction first:
going down from the longest length, a piece is fixed together with a small set of
pieces if that set provably dominates every other set that fits beside it (Martello
and Toth 1990, 8.5); the remainder is packed best fit, longest first.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm.bpe import byte_names
from tillscope.operators.ordering import row_index
from tillscope.session import materialise, ship_package

CAPACITY = 2048

_CACHE_ENTRIES = 500_000
# ``str.split`` cuts at these too, the tokenizer does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_VISIBLE = regex.compile(r"\S+")
# Beyond these characters, or with what may be an added token, the library decides.
_WIDE = regex.compile(r"[^\x00-\xff]|<\|")


class WordCoder:
    """Token ids by the tokenizers library, remembered by white-space-free run.

    For tokenizers that drop white space and never join across it: the ids of a
    text are those of its runs, one after the other. A new run is cut into words
    by the tokenizer's own pattern, and only new words go to its model. That holds
    for characters up to U+00FF, which its normaliser leaves as they are but for
    lower case; other runs go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        steps = [s["type"] for s in (described["normalizer"] or {}).get("normalizers", [])]
        cuts = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.model = None
        if steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == [
            "Split",
            "ByteLevel",
        ]:
            self.model = self.library.model
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
            names = {b: name for name, b in byte_names().items()}
            self.names = [names[b] for b in range(256)]

    def _word(self, word: str) -> bytes:
        named = word
        if not (word.isascii() and word.isprintable()):
            named = "".join(self.names[b] for b in word.encode())
        return np.array([t.id for t in self.model.tokenize(named)], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if self.model is None or _WIDE.search(run) is not None:
            return np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        ids = []
        for word in self.pattern.findall(run.lower()):
            found = self.words.get(word)
            if found is None:
                if len(self.words) >= _CACHE_ENTRIES:
                    self.words.clear()
                found = self.words[word] = self._word(word)
            ids.append(found)
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        runs = text.split() if _SEPARATORS.search(text) is None else _VISIBLE.findall(text)
        new = list(set(runs).difference(self.known))
        if new:
            if len(self.known) > _CACHE_ENTRIES:
                self.known.clear()
                new = list(set(runs))
            self.known.update((run, self._run(run)) for run in new)
        return b"".join(map(self.known.__getitem__, runs))


_LOADED: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    if path not in _LOADED:
        _LOADED[path] = WordCoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document.

    A document is the ids of its text, then id 0; a null text is just id 0. Only
    documents longer than ``capacity`` are cut.
    """
    ship_package(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = coder.encode(text.as_py() or "") + bytes(4)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    values = (doc_id.as_py(), piece, at // 4, len(own) // 4, zlib.crc32(own))
                    for column, value in zip(rows, values):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, types)], names
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# A pattern is a multiset of lengths, longest first, as ((length, copies), ...);
# a plan is a list of (pattern, number of bins packed that way).
Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


class _Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def largest(self, room: int) -> int:
        at = bisect.bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def put(self, size: int, n: int) -> None:
        if size not in self.counts:
            bisect.insort(self.sizes, size)
        self.counts[size] = self.counts.get(size, 0) + n

    def least_sum(self, n: int, above: int = 0) -> int | None:
        """The sum of the ``n`` shortest pieces longer than ``above``; None if fewer."""
        total = 0
        at = bisect.bisect_right(self.sizes, above)
        for size in self.sizes[at : at + n]:
            used = min(n, self.counts[size])
            total, n = total + size * used, n - used
            if not n:
                return total
        return None

    def best_pair(self, room: int) -> tuple[int, int]:
        """The pair (longer, shorter) with the largest sum that fits, or (0, 0)."""
        best, low = (0, 0), 0
        high = bisect.bisect_right(self.sizes, room) - 1
        while high >= low:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > room:
                high -= 1
                continue
            if a + b > sum(best) and (high != low or self.counts[a] > 1):
                best = (a, b)
            low += 1
        return best


def _dominating(stock: _Stock, room: int) -> tuple[int, ...] | None:
    """Companions that dominate all others in ``room``, or None if that is not proven.

    Nothing fits: none. The largest piece t that fits fills the room, or no two
    pieces fit, or no three fit and t is at least the largest fitting pair: t,
    since whatever stands there could be exchanged for t. No three fit, t is in
    the largest fitting pair (t, b), and no two pieces longer than b fit: that
    pair, since of any other pair one part is at most t and the other at most b.
    """
    t = stock.largest(room)
    if not t:
        return ()
    two = stock.least_sum(2)
    if t == room or two is None or two > room:
        return (t,)
    three = stock.least_sum(3)
    if three is None or three > room:
        a, b = stock.best_pair(room)
        if t >= a + b:
            return (t,)
        longer = stock.least_sum(2, above=b)
        if t == a and (longer is None or longer > room):
            return (a, b)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Fix dominating sets, from the longest piece down; return them and what remains.

    A choice holds for all equal pieces at once, since taking pieces away never
    lets more sets fit.
    """
    plan: Plan = []
    stock = _Stock(counts)
    for size in sorted(stock.sizes, reverse=True):
        while size in stock.counts:
            stock.take(size, 1)  # its companions are looked for among the others
            companions = _dominating(stock, capacity - size)
            stock.put(size, 1)
            if companions is None:
                break
            need: dict[int, int] = {}
            for s in (size, *companions):
                need[s] = need.get(s, 0) + 1
            bins = min(stock.counts[s] // k for s, k in need.items())
            plan.append((tuple(sorted(need.items(), reverse=True)), bins))
            for s, k in need.items():
                stock.take(s, k * bins)
    return plan, stock.counts


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, over groups of bins with equal content.

    Open bins are grouped by room; a group takes as many pieces of a length at
    once as it can, so the work depends on the number of lengths and not on the
    number of pieces.
    """
    groups: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    rooms = [capacity]

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, bins))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            while at < len(rooms) - 1 and not groups[rooms[at]]:
                del groups[rooms[at]], rooms[at]
            room = rooms[at]
            each = room // size
            pattern, bins = groups[room].pop() if groups[room] else ((), -(-left // each))
            full = min(bins, left // each)
            if full:
                put(room - each * size, (*pattern, (size, each)), full)
                left -= full * each
            rest = bins - full
            if rest and left:  # fewer than ``each`` are left: one bin takes them
                put(room - left * size, (*pattern, (size, left)), 1)
                left, rest = 0, rest - 1
            if rest and pattern:
                put(room, pattern, rest)
    return [entry for found in groups.values() for entry in found]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack a histogram of lengths 1..capacity into as few bins as the method finds."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(plan: Plan, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """The plan as intervals of piece ranks (by length, then rank within it)."""
    first, total = {}, 0
    for size in sorted(counts):
        first[size] = total
        total += counts[size]
    used = dict.fromkeys(counts, 0)
    rows, base = [], 0
    for pattern, bins in plan:
        offset = 0
        for size, copies in pattern:
            rows.append((first[size] + used[size], size, copies, base, offset))
            used[size] += bins * copies
            offset += size * copies
        base += bins
    rows.sort()
    names = ("rank", "length", "copies", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``token_pieces``.

    Pieces are ranked by length, document and piece over range partitions, so a
    common length is spread over many tasks. Each rank finds its place in the
    plan's intervals by binary search; the intervals are bounded by the capacity
    (lengths times groups of equal bins), not by the pieces.
    """
    pieces = materialise(pieces)
    counts = {
        r["length"]: r["n"]
        for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }  # at most ``capacity`` rows
    slots = pieces.sparkSession.sparkContext.broadcast(
        _slots(pack_histogram(counts, capacity), counts)
    )
    ranked = row_index(
        pieces, ["length", F.col("doc_id").asc_nulls_last(), "piece", "start", "ids_crc32"], "_rank"
    )
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = slots.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(plan["rank"], rank, side="right") - 1
            within, slot = np.divmod(rank - plan["rank"][at], plan["copies"][at])
            sequence = plan["sequence"][at] + within
            offset = plan["offset"][at] + slot * plan["length"][at]
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    schema = ", ".join(
        [*(f"`{c}` {t}" for c, t in pieces.dtypes), "sequence_id long", "offset long"]
    )
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the token pieces of every document into sequences of ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset per
    piece. Null and empty texts are one piece of length 1; rows without an id and
    repeated rows are documents of their own. An empty table gives no rows. Other
    columns are dropped.
    """
    return pack(token_pieces(docs, path, capacity), capacity)
