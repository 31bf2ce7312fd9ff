"""Substring dedup by hashing units: whole lines and paragraphs, and blocks of words.

Blocks have a fixed number of words and start where the hash of the block is the
least in a window of neighbours, so the same run of words has the same blocks
wherever it stands. Units are in lower case with single spaces. Digests are grouped
over all documents; the earliest document keeps a unit and it is removed everywhere
else. Offsets are those of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import apart, carried, restored
from tillscope.session import scratch_path, ship_package

# Words in a block: long enough that only copied text repeats one, and half of the
# passages of fifty words that are to be found. Any run of 2 * UNIT_WORDS - 2 words
# holds a whole block, and a shared run loses all but UNIT_WORDS - 2 words at each end.
UNIT_WORDS = 25
# Words in a line or paragraph that is a unit of its own.
MIN_LINE_WORDS = 10

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BREAK = re.compile("\n")
_BASE = 0x9E3779B97F4A7C15
# A document without an id ranks behind all others.
_LAST = (1 << 63) - 1


def _rank(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def window_hashes(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """A hash of every run of ``size`` words. ``known`` keeps those of words."""
    if len(known) > 1 << 18:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    powers = np.cumprod(np.full(len(words), _BASE, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * powers)))
    inverse = np.cumprod(np.full(len(words) - size + 1, pow(_BASE, -1, 1 << 64), np.uint64))
    hashes = (sums[size:] - sums[:-size]) * inverse
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_BASE)
    return hashes ^ (hashes >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int) -> list[int]:
    """Positions whose hash is the least of some ``window`` neighbours (winnowing).

    Of equal hashes close together only as many stay as keep one in every window.
    """
    view = np.lib.stride_tricks.sliding_window_view(hashes, min(window, len(hashes)))
    kept: list[int] = []
    for at in np.unique(np.argmin(view, axis=1) + np.arange(len(view))).tolist():
        while (
            len(kept) > 1
            and at - kept[-2] <= window
            and hashes[kept[-2]] == hashes[kept[-1]] == hashes[at]
        ):
            kept.pop()
        kept.append(at)
    return kept


def whole_lines(text: str, starts: list[int], least: int = MIN_LINE_WORDS) -> set[tuple[int, int]]:
    """Word ranges of the lines and paragraphs (between blank lines) of ``least`` words."""
    breaks = np.fromiter((m.start() for m in _BREAK.finditer(text)), np.int64)
    places, times = np.unique(np.searchsorted(starts, breaks), return_counts=True)
    found = set()
    for at in (places, places[times > 1]):
        bounds = [0, *at.tolist(), len(starts)]
        found.update((a, b) for a, b in zip(bounds, bounds[1:]) if b - a >= least)
    return found


def units_of(text: str, size: int, known: dict[str, int]) -> Iterator[tuple[bytes, int, int]]:
    """``(digest, start, end)`` of every unit of a text, offsets in code points."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    ranges = whole_lines(text, [a for a, _ in spans])
    if len(words) >= size:
        # A window below the size of a unit: neighbouring units overlap.
        starts = anchors(window_hashes(words, size, known), size - 1)
        ranges.update((n, n + size) for n in starts)
    for a, b in sorted(ranges):
        digest = xxhash.xxh3_128_digest(" ".join(words[a:b]).encode("utf-8", "surrogatepass"))
        yield digest, spans[a][0], spans[b - 1][1]


def hashed_units(docs: DataFrame, size: int = UNIT_WORDS) -> DataFrame:
    """``(h1, h2, doc, mark, start, end, again)`` for every unit.

    ``again`` tells that the unit stands earlier in the document, and apart. A row is told
    from others of the same id by a hash of its text (``mark``).
    """
    ship_package(docs.sparkSession)
    names = ["h1", "h2", "doc", "mark", "start", "end", "again"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, mark, text in zip(*[batch.column(c).to_pylist() for c in ("doc", "mark", "text")]):
                seen: dict[bytes, int] = {}
                for digest, start, end in units_of(text or "", size, known):
                    values = (
                        int.from_bytes(digest[:8], "big", signed=True),
                        int.from_bytes(digest[8:], "big", signed=True),
                        doc, mark, start, end, start >= seen.setdefault(digest, end),
                    )
                    for column, value in zip(rows, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names)

    text = F.col("text").cast("string")
    return docs.select(
        _rank(F.col("doc_id")).alias("doc"), _mark(text).alias("mark"), text.alias("text")
    ).mapInArrow(
        run, "h1 long, h2 long, doc long, mark long, start int, end int, again boolean"
    )


def repeated_spans(docs: DataFrame, size: int = UNIT_WORDS) -> DataFrame:
    """``(doc, mark, spans)``: per document the merged spans to remove, in order.

    ``spans`` is an array of (start, end, kept_doc): code points from start up to
    end, and the document that keeps the first unit of the span. A digest's
    earliest document is an aggregate combined before the shuffle, so a passage in
    a third of all documents is no hot group; it comes back by a plain join.
    """
    # Written once: hashing costs more than reading the units twice.
    path = scratch_path(docs.sparkSession, "units")
    hashed_units(docs, size).write.parquet(path)
    units = docs.sparkSession.read.parquet(path)
    firsts = (
        units.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        .agg(F.min("doc").alias("kept_doc"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(apart(F.col("_h1")).alias("_h1"), "_h2", "kept_doc")
    )
    later = units.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(
        "doc > kept_doc OR again"
    )
    found = later.groupBy("doc", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "kept_doc"))).alias("found")
    )
    merged = F.aggregate(
        "found",
        F.array().cast("array<struct<start:int,end:int,kept_doc:bigint>>"),
        lambda done, unit: F.when(
            (F.size(done) > 0) & (unit["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], unit["end"]).alias("end"),
                        F.element_at(done, -1)["kept_doc"].alias("kept_doc"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(unit))),
    )
    return found.select("doc", "mark", merged.alias("spans"))


def removed_spans(docs: DataFrame, size: int = UNIT_WORDS) -> DataFrame:
    """One row per removed span: ``(doc_id, start, end, kept_doc_id)``.

    Documents that lose nothing have no row; null, empty and short texts have no
    units. Rows of one id are one document: only what repeats an earlier document,
    or stands twice in one text, is removed. Rows without an id rank behind all
    others and come back with a null id. Repeated rows give their spans once.
    """
    spans = repeated_spans(docs, size).select("doc", F.explode("spans").alias("span"))

    def id_of(doc: Column) -> Column:
        return F.when(doc != _LAST, doc)

    return spans.select(
        id_of(F.col("doc")).alias("doc_id"),
        F.col("span.start").cast("long").alias("start"),
        F.col("span.end").cast("long").alias("end"),
        id_of(F.col("span.kept_doc")).alias("kept_doc_id"),
    )


def remove_spans(docs: DataFrame, size: int = UNIT_WORDS) -> DataFrame:
    """``docs`` with the spans taken out of ``text``; all rows and columns stay."""
    spans = repeated_spans(docs, size).select(
        F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "spans"
    )
    used = ["doc_id", "text"]
    joined = carried(docs, used).join(
        spans,
        (_rank(F.col("doc_id")) == F.col("_doc")) & (_mark(F.col("text")) == F.col("_mark")),
        "left",
    )
    # The parts between the spans, from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    parts = F.transform(
        starts,
        lambda start, n: F.substring(
            F.col("text"),
            start + 1,
            F.coalesce(F.get("spans", n)["start"], F.length("text")) - start,
        ),
    )
    cut = F.when(F.col("spans").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text"))
    return restored(joined, docs.columns, used, {"text": cut}).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
