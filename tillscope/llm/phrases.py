"""Collocations from counts of words and phrases kept as sorted streams.

The counts of all phrases lie in prefix order (a phrase behind its first words) and
in suffix order (behind its last words). A pass over each order carries the counts
of the phrases that the current one begins or ends with, so left, right and
extension counts come from neighbours in a stream and not from lookups. The two
streams are then merge-joined phrase by phrase.

Only phrases of words that are frequent enough themselves can be frequent: words
are counted first, by one dictionary per chunk of text, and rare ones cut pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.chunks import chunk_id, entries, squeezed, unsqueezed, written
from tillscope.llm.columns import apart
from tillscope.operators.ordering import row_index
from tillscope.session import materialise, ship_package

LEAST = 10
SHARE = 50
TOP = 2000

# Three positions in a chunk's dictionary fit 63 bits.
_CHUNK_WORDS = 1 << 20
_CONTEXT = 2
_BATCH = 1 << 16
# Phrases of a bucket, about 24 bytes each while a task sums them; runs of one batch.
_BUCKET_PHRASES = 1 << 21
_RUNS = 64
# Odd multipliers that spread phrases over buckets.
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALT = 64
# Characters that end a piece; a tab is a space.
_MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")


def _tokens(text: str) -> list[bytes]:
    """Words in lower case, with a line feed where a piece ends."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_MARKS)
    return [w for w in data.replace(b"\n", b" \n ").split(b" ") if w]


class _Chunk:
    """A run of words by their position in the chunk's dictionary; 0 ends a piece."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.known: list[dict[bytes, int]] = []
        self.size = 1
        self.at: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.langs:
            self.langs.append(lang)
            self.known.append({b"\n": 0})
        known = self.known[self.langs.index(lang)]
        for word in words:
            if word not in known:
                known[word] = self.size
                self.size += 1
        self.at.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.at.append(np.zeros(1, np.int32))
        self.held += len(words) + 1

    def row(self, chunk: int, fresh: int) -> pa.RecordBatch:
        """The chunk; its first ``fresh`` places belong to the one before."""
        at = np.concatenate(self.at) if self.at else np.zeros(0, np.int32)
        times = np.bincount(at[fresh:], minlength=self.size)
        langs, words, places = [], [], []
        for lang, known in zip(self.langs, self.known):
            own = [w for w in known if w != b"\n"]
            langs += [lang] * len(own)
            words += [w.decode("utf-8", "surrogatepass") for w in own]
            places += [known[w] for w in own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([langs], pa.list_(pa.string())),
                pa.array([words], pa.list_(pa.string())),
                pa.array([places], pa.list_(pa.int32())),
                pa.array([times[places]], pa.list_(pa.int64())),
                pa.array([len(at)], pa.int64()),
                pa.array([fresh], pa.int64()),
                pa.array([squeezed(at)], pa.binary()),
            ],
            [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")],
        )


_CHUNK_SCHEMA = (
    "chunk long, lang array<string>, word array<string>, place array<int>, times array<long>, "
    "size long, fresh long, content binary"
)


def word_chunks(docs: DataFrame, chunk_words: int = _CHUNK_WORDS) -> DataFrame:
    """Chunks of the words of ``docs(text, lang)``, written to the shared folder.

    A text of any length is cut into chunks; each starts with the last two words
    of the one before, so that no phrase is lost between them.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, fresh = _Chunk(), 0, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang, words = lang.as_py(), _tokens(text.as_py() or "")
                start = 0
                while start < len(words):
                    room = chunk_words - chunk.held
                    part = words[start : start + room]
                    chunk.add(lang, part)
                    start += len(part)
                    if chunk.held >= chunk_words:
                        yield chunk.row(chunk_id(n), fresh)
                        chunk, n, fresh = _Chunk(), n + 1, 0
                        if start < len(words):
                            context = words[max(0, start - _CONTEXT) : start]
                            chunk.add(lang, context)
                            chunk.at.pop()  # the piece goes on
                            chunk.held -= 1
                            fresh = len(context)
        if chunk.held:
            yield chunk.row(chunk_id(n), fresh)

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string"),
    )
    return written(rows.mapInArrow(run, _CHUNK_SCHEMA), "words")


def word_counts(chunks: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of all words of ``word_chunks``."""
    return (
        entries(chunks, "lang", "word", "times")
        .groupBy("lang", "word")
        .agg(F.sum("times").alias("n"))
    )


def _blob(head: np.ndarray, third: np.ndarray, times: np.ndarray) -> bytes:
    """Phrases in ascending order: gaps of the first two ids, third ids and counts.

    Laid out by the place of the byte, so that the many zero bytes lie together.
    """
    columns = (np.diff(head, prepend=0), third.astype(np.int32), times.astype(np.int32))
    return squeezed(
        np.concatenate(
            [c.view(np.uint8).reshape(len(c), c.itemsize).T.ravel() for c in columns]
        )
    )


def _unblob(data: bytes, size: int) -> list[np.ndarray]:
    """``head``, ``third`` and ``times`` of ``_blob``."""
    flat, start, columns = unsqueezed(data, 16 * size, "u1"), 0, []
    for kind in (np.int64, np.int32, np.int32):
        width = np.dtype(kind).itemsize
        planes = flat[start : start + width * size].reshape(width, size)
        columns.append(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))
        start += width * size
    return [np.cumsum(columns[0]), *columns[1:]]


def _summed(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The phrases of several runs with the sums of their counts."""
    head, third, times = (np.concatenate(columns) for columns in zip(*runs))
    order = np.lexsort((third, head))
    head, third = head[order], third[order]
    new = np.flatnonzero(
        np.concatenate(([True], (np.diff(head) != 0) | (np.diff(third) != 0)))
    )
    return [head[new], third[new], np.add.reduceat(times[order], new)]


def _phrase_counts(
    chunks: DataFrame, vocabulary: DataFrame, least: int, bucket_phrases: int = _BUCKET_PHRASES
) -> DataFrame:
    """``(w1, w2, w3, n)`` of the frequent phrases of two (``w3`` 0) and three words.

    Words are ids of ``vocabulary(lang, word, id)``; other words cut pieces. A chunk
    deals its phrases out as one sorted run per bucket of hashes. The number of
    buckets grows with the words, so a bucket holds about ``bucket_phrases`` phrases
    at every size, and one phrase at most once per chunk.
    """
    known = (
        entries(chunks, "lang", "word", "place")
        .join(
            vocabulary.select(F.col("lang").alias("_l"), F.col("word").alias("_w"), "id"),
            (F.col("lang") == F.col("_l")) & (F.col("word") == F.col("_w")),
        )
        .select(F.col("chunk").alias("of"), "place", "id")
    )
    positions = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = 1 + 2 * positions // bucket_phrases

    def run(rows: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        row = {c: rows.column(c)[0].as_py() for c in ("size", "fresh", "content")}
        at = unsqueezed(row["content"], row["size"], "<i4")
        place, ids = words.column("place").to_numpy(), words.column("id").to_numpy()
        order = np.argsort(ids)
        place, ids = place[order], ids[order]
        # Positions among the frequent words alone, in the order of ids; 0 for all others.
        short = np.zeros(max(at.max(initial=0), place.max(initial=0)) + 1, np.int64)
        short[place] = np.arange(1, len(place) + 1)
        ids = np.concatenate(([0], ids))
        own, width = short[at], len(ids)
        runs = []
        for length in (2, 3):
            ends = np.arange(max(row["fresh"], length - 1), len(own))
            held = [own[ends - length + 1 + k] for k in range(length)]
            key = np.zeros(len(ends), np.int64)
            for part in held:
                key = key * width + part
            key = key[np.logical_and.reduce([part > 0 for part in held])]
            key, times = np.unique(key, return_counts=True)
            parts = []
            for _ in range(length):
                parts.insert(0, ids[key % width])
                key = key // width
            third = parts[2] if length == 3 else np.zeros(len(times), np.int64)
            runs.append([(parts[0] << 32) | parts[1], third, times])
        head, third, times = (np.concatenate(columns) for columns in zip(*runs))
        mixed = (head.astype(np.uint64) * _MIX) ^ ((third.astype(np.uint64) + 1) * _MIX2)
        mixed ^= mixed >> np.uint64(29)
        bucket = ((mixed * _MIX) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        columns = [c[order] for c in (head, third, times)]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        stops = np.append(starts[1:], len(bucket))
        for n in range(0, len(starts), _RUNS):
            spans = list(zip(starts[n : n + _RUNS], stops[n : n + _RUNS]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket[i] for i, _ in spans], pa.int64()),
                    pa.array([k - i for i, k in spans], pa.int64()),
                    pa.array([_blob(*[c[i:k] for c in columns]) for i, k in spans], pa.binary()),
                ],
                ["bucket", "size", "run"],
            )

    def grams(rows: pa.Table, words: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("run", pa.binary())])
        return pa.Table.from_batches(run(rows, words), schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, waiting = [], 0
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("run")):
                runs.append(_unblob(data.as_py(), size))
                waiting += size
                if waiting > bucket_phrases:
                    runs, waiting = [_summed(runs)], 0
        head, third, times = _summed(runs)
        found = np.flatnonzero(times >= least)
        columns = (head >> 32, head & ((1 << 32) - 1), third, times)
        for n in range(0, len(found), _BATCH):
            some = found[n : n + _BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[some], pa.int64()) for c in columns], ["w1", "w2", "w3", "n"]
            )

    return (
        chunks.select("chunk", "size", "fresh", "content")
        .groupBy("chunk")
        .cogroup(known.groupBy("of"))
        .applyInArrow(grams, "bucket long, size long, run binary")
        .groupBy("bucket")
        .applyInArrow(merged, "w1 long, w2 long, w3 long, n long")
    )


def _scanned(counts: DataFrame) -> DataFrame:
    """One pass over ``counts(x, y, z, n)``, which are 0 beyond a phrase's length, in order.

    Rows ``(x, y, z, n, one, two)`` for phrases of two and three words: ``one`` is
    the count of (x), ``two`` of (x, y) for three words. And rows ``(x, y, 0, ext)``
    with the largest count of a stretch of phrases (x, y, z).

    Range partitions cut the stream anywhere; each starts with the last counts of
    one and two words before it, one row per partition.
    """
    stream = materialise(
        counts.orderBy("x", "y", "z").withColumn("part", F.spark_partition_id())
    )
    single = (F.col("y") == 0) & (F.col("z") == 0)
    double = (F.col("y") != 0) & (F.col("z") == 0)
    ends = stream.groupBy("part").agg(
        F.max(F.when(single, F.struct("x", "n"))).alias("one"),
        F.max(F.when(double, F.struct("x", "y", "n"))).alias("two"),
    )
    carry, one, two = {}, 0, 0
    for row in sorted(ends.collect(), key=lambda r: r["part"]):  # one row per partition
        carry[row["part"]] = (one, two)
        one = row["one"]["n"] if row["one"] else one
        two = row["two"]["n"] if row["two"] else two
    names = ["x", "y", "z", "n", "one", "two", "ext"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, z, n, part = (
                batch.column(c).to_numpy() for c in ("x", "y", "z", "n", "part")
            )
            last = carry[int(part[0])] if last is None else last
            counts = []
            for before, mask in zip(last, (y == 0, (y != 0) & (z == 0))):
                seen = np.maximum.accumulate(np.where(mask, np.arange(1, len(n) + 1), 0))
                counts.append(np.concatenate(([before], n))[seen])
            last = tuple(int(c[-1]) for c in counts)
            phrases = np.flatnonzero(y != 0)
            longer = np.flatnonzero(z != 0)
            found = [c[phrases] for c in (x, y, z, n, *counts)]
            rows = len(phrases)
            if len(longer):
                new = np.flatnonzero(
                    np.concatenate(
                        ([True], (np.diff(x[longer]) != 0) | (np.diff(y[longer]) != 0))
                    )
                )
                ext = np.maximum.reduceat(n[longer], new)
                empty = np.zeros(len(new), np.int64)
                extra = [x[longer][new], y[longer][new], empty, empty, empty, empty]
                found = [np.concatenate(pair) for pair in zip(found, extra)]
                found.append(np.concatenate((np.zeros(rows, np.int64), ext)))
            else:
                found.append(np.zeros(rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names)

    return materialise(stream.mapInArrow(run, ", ".join(f"{c} long" for c in names)))


def _extended(scan: DataFrame, *names: str) -> DataFrame:
    x, y = names
    return scan.where("n = 0").select(F.col("x").alias(x), F.col("y").alias(y), "ext")


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10 ** 16."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(16,0)")

    scaled = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled, wide(left) * wide(right))


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    chunk_words: int = _CHUNK_WORDS,
) -> DataFrame:
    """The strongest phrases of two and three words of each language of ``docs(text, lang)``.

    Words are split at spaces and tabs within pieces between ``.,;:!?`` and line
    ends; A-Z count as a-z. Phrases found ``least`` times or more are scored
    floor(1000000 a a / (l r)) at their weakest cut, ties to the first; one of which
    a longer one has ``share`` percent of the occurrences is dropped. Returns the
    first ``top`` per language by score, count and phrase: lang, rank, phrase, a, l,
    r, n (all words of the language) and score.

    A null language is ``und``; null and empty texts have no words; repeated rows
    count again; an empty table gives no rows; other columns are not read.
    """
    if least < 1 or not _CONTEXT < chunk_words <= _CHUNK_WORDS:
        raise ValueError("least must be 1 or more, and chunk_words from 3 to 1 << 20")
    chunks = word_chunks(docs, chunk_words)
    counted = materialise(word_counts(chunks).where(F.col("n") >= least))
    totals = entries(chunks, "lang", "times").groupBy("lang").agg(F.sum("times").alias("n"))
    # Ids are 1, 2, 3, ... by language and word, and are written once.
    vocabulary = written(row_index(counted, ["lang", "word"], "id"), "vocabulary")
    if (vocabulary.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more frequent words than ids: raise least")
    phrases = materialise(_phrase_counts(chunks, vocabulary, least))
    zero = F.lit(0).cast("long")
    words = vocabulary.select(F.col("id").alias("x"), zero.alias("y"), zero.alias("z"), "n")
    forward = _scanned(
        words.unionByName(
            phrases.select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("w3").alias("z"), "n")
        )
    )
    three = F.col("w3") != 0
    backward = _scanned(
        words.unionByName(
            phrases.select(
                F.when(three, F.col("w3")).otherwise(F.col("w2")).alias("x"),
                F.when(three, F.col("w2")).otherwise(F.col("w1")).alias("y"),
                F.when(three, F.col("w1")).otherwise(zero).alias("z"),
                "n",
            )
        )
    )
    deep = F.col("z") != 0
    left = forward.where("n > 0").select(
        F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("z").alias("w3"),
        F.col("n").alias("a"), F.col("one").alias("l1"), F.col("two").alias("l2"),
    )
    right = backward.where("n > 0").select(
        F.when(deep, F.col("z")).otherwise(F.col("y")).alias("w1"),
        F.when(deep, F.col("y")).otherwise(F.col("x")).alias("w2"),
        F.when(deep, F.col("x")).otherwise(zero).alias("w3"),
        F.col("one").alias("r1"), F.col("two").alias("r2"),
    )
    longer = (
        _extended(forward, "w1", "w2")
        .unionByName(_extended(backward, "w2", "w1"))
        .groupBy("w1", "w2")
        .agg(F.max("ext").alias("ext"))
        .withColumn("w3", zero)
    )
    both = left.join(right.hint("merge"), ["w1", "w2", "w3"]).join(
        longer.hint("merge"), ["w1", "w2", "w3"], "left"
    )
    kept = both.where(
        F.col("ext").isNull() | (F.col("ext") * 100 < F.col("a") * share)
    )
    # Cut behind the first word; three words also behind the second.
    first = F.struct(
        _floor_score(F.col("a"), F.col("l1"), F.when(F.col("w3") != 0, F.col("r2")).otherwise(F.col("r1"))).alias("score"),
        F.lit(1).alias("k"),
        F.col("l1").alias("l"),
        F.when(F.col("w3") != 0, F.col("r2")).otherwise(F.col("r1")).alias("r"),
    )
    second = F.when(
        F.col("w3") != 0,
        F.struct(
            _floor_score(F.col("a"), F.col("l2"), F.col("r1")).alias("score"),
            F.lit(2).alias("k"),
            F.col("l2").alias("l"),
            F.col("r1").alias("r"),
        ),
    )
    cut = F.array_min(F.array_compact(F.array(first, second)))
    scored = materialise(kept.select("w1", "w2", "w3", "a", cut.alias("cut")))
    named = scored
    for k in (1, 2, 3):
        word = vocabulary.select(
            apart(F.col("id")).alias(f"_{k}"), F.col("word").alias(f"word{k}"),
            *[F.col("lang")] * (k == 1),
        )
        named = named.join(word, F.col(f"w{k}") == F.col(f"_{k}"), "left")
    named = named.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "cut.*"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALT))).orderBy(*order)
    some = named.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        some.withColumn("rank", place.cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
