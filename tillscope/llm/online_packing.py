"""Packing of token sequences as documents come, with a bounded number of open windows.

Each task keeps a few open windows. A piece goes into the one that it fills best;
when it fits none, the fullest is filled up with its beginning and emitted. What is
left open at the ends of the tasks is merged the same way, many tasks at a time,
until one group remains; its rest is cut into sequences of a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.packing import word_coder
from tillscope.session import scratch_path, ship_package

CAPACITY = 4096
OPEN_WINDOWS = 16
# Tasks whose open windows are merged in one.
MERGED = 32


class Piece(NamedTuple):
    """Consecutive ids of a document, as little-endian unsigned 32-bit integers."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(
            start=self.start + n, ids=self.ids[4 * n :]
        )


class OpenWindows:
    """Up to ``limit`` open windows of ``capacity`` ids."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.rooms: list[int] = []
        self.held: list[list[Piece]] = []

    def _put(self, at: int, piece: Piece) -> Iterator[list[Piece]]:
        self.rooms[at] -= len(piece.ids) // 4
        self.held[at].append(piece)
        if not self.rooms[at]:
            del self.rooms[at]
            yield self.held.pop(at)

    def offer(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; the sequences that are full now."""
        while True:
            size = len(piece.ids) // 4
            if size >= self.capacity:
                head, piece = piece.cut(self.capacity)
                yield [head]
                if not piece.ids:
                    return
                continue
            best = -1
            for at, room in enumerate(self.rooms):
                if room >= size and (best < 0 or room < self.rooms[best]):
                    best = at
            if best < 0 and len(self.rooms) < self.limit:
                self.rooms.append(self.capacity)
                self.held.append([])
                best = len(self.rooms) - 1
            if best >= 0:
                yield from self._put(best, piece)
                return
            fullest = self.rooms.index(min(self.rooms))
            head, piece = piece.cut(self.rooms[fullest])
            yield from self._put(fullest, head)

    def close(self) -> Iterator[list[Piece]]:
        """All that is open as full sequences, and the rest by powers of two."""
        pieces = [p for held in self.held for p in held]
        self.rooms, self.held = [], []
        left = sum(len(p.ids) // 4 for p in pieces)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            made = []
            while room:
                head, rest = pieces[0].cut(min(room, len(pieces[0].ids) // 4))
                made.append(head)
                room -= len(head.ids) // 4
                pieces[:1] = [rest] if rest.ids else []
            yield made


_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, part long, ids binary"
)
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 8 + [pa.binary()]


class _Rows:
    """Rows of one task: placed pieces, and open ones with their ids."""

    def __init__(self, level: int, part: int) -> None:
        self.next, self.part = (level << 60) | (part << 30), part
        self.columns: list[list] = [[] for _ in _NAMES]

    def add(self, sequences: Iterator[list[Piece]], placed: bool = True) -> None:
        for sequence in sequences:
            offset = 0
            for p in sequence:
                size = len(p.ids) // 4
                known = (zlib.crc32(p.ids), p.doc_tokens, self.next, offset, self.part, None)
                still = (None, p.doc_tokens, None, None, self.part, p.ids)
                row = (p.doc_id, p.start, size, *(known if placed else still))
                for column, value in zip(self.columns, row):
                    column.append(value)
                offset += size
            self.next += 1

    def taken(self) -> list[pa.Array]:
        made = [pa.array(c, t) for c, t in zip(self.columns, _TYPES)]
        self.columns = [[] for _ in _NAMES]
        return made


def _first_level(docs: DataFrame, path: str, end: int, capacity: int, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = word_coder(path), end.to_bytes(4, "little")
        windows = OpenWindows(capacity, limit)
        rows = _Rows(0, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = coder.encode(text.as_py() or "") + last
                rows.add(windows.offer(Piece(doc_id.as_py(), 0, ids, len(ids) // 4)))
            yield pa.RecordBatch.from_arrays(rows.taken(), _NAMES)
        rows.add(windows.held, placed=False)
        yield pa.RecordBatch.from_arrays(rows.taken(), _NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _SCHEMA
    )


def _merged(open_: DataFrame, level: int, final: bool, capacity: int, limit: int) -> DataFrame:
    """One level of merging: the open pieces of ``MERGED`` tasks, longest first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [
            Piece(*row)
            for row in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))
        ]
        pieces.sort(key=lambda p: (-len(p.ids), p.doc_id is None, p.doc_id or 0, p.start, p.ids))
        windows, rows = OpenWindows(capacity, limit), _Rows(level, key[0].as_py())
        for piece in pieces:
            rows.add(windows.offer(piece))
        if final:
            rows.add(windows.close())
        else:
            rows.add(windows.held, placed=False)
        return pa.Table.from_arrays(rows.taken(), _NAMES)

    group = F.floor(F.col("part") / MERGED).cast("long").alias("_group")
    return open_.groupBy(group).applyInArrow(run, _SCHEMA)


def pack_online(
    docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, limit: int = OPEN_WINDOWS
) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)`` into sequences of ``capacity`` ids.

    A document is the ids of its text and ``end``; a null text is just that. Returns
    per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.
    All sequences are full but for at most one of each smaller power of two, so none
    needs padding. A document is cut where it fills a window, otherwise it stays
    whole. Open windows hold at most ``limit * capacity`` ids per task and move with
    their ids to the merge, which takes ``MERGED`` tasks in one at each level.

    Rows without an id and repeated rows are documents of their own, other columns
    are dropped, an empty table gives no rows. Each level is written to the shared
    folder: a lost executor costs its tasks, which give the same pieces again.
    """
    spark = docs.sparkSession
    ship_package(spark)
    where = scratch_path(spark, "packed")
    _first_level(docs, path, end, capacity, limit).write.parquet(f"{where}/0")
    levels = [spark.read.schema(_SCHEMA).parquet(f"{where}/0")]
    while True:
        open_ = levels[-1].where("ids IS NOT NULL")
        last = open_.agg(F.max("part")).first()[0]
        if last is None:
            break
        level, final = len(levels), last < MERGED
        _merged(open_, level, final, capacity, limit).write.parquet(f"{where}/{level}")
        levels.append(spark.read.schema(_SCHEMA).parquet(f"{where}/{level}"))
    placed = levels[0]
    for rows in levels[1:]:
        placed = placed.unionByName(rows)
    return placed.where("sequence_id IS NOT NULL").select(*_NAMES[:7])
