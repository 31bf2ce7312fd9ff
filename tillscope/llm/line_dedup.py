"""Line dedup: of a line that many documents hold, only the first document keeps it.

Only hashes travel. Line hashes are range-partitioned, with document and position
as secondary sort; one pass over each sorted range streams the first occurrences.
The result is a compressed keep bitmap per document and not its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.columns import carried, restored
from tillscope.llm.quality_rules import WHITE_SPACE, fenced
from tillscope.session import materialise

# The shortest key that counts, in code points.
MIN_KEY_CHARS = 10

# A document without an id ranks behind all others.
_LAST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE_SPACE))
    # ``lower`` is fast and right for ASCII text; other text needs A-Z alone changed.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _LOWER)
    )


def _rank(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_LAST))


def _text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame) -> DataFrame:
    """One row per line whose key is long enough: two hashes, document, position.

    Two 64-bit hashes with different seeds stand for the key. A row is told from
    others of the same id by a hash of its text.
    """
    lines = docs.select(
        _rank(F.col("doc_id")).alias("doc"),
        _text_mark(F.col("text")).alias("mark"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    )
    keyed = lines.select("doc", "mark", "pos", fenced(line_key(F.col("line"))).alias("key"))
    return keyed.where(F.length("key") >= MIN_KEY_CHARS).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "mark", "pos"
    )


def hot_hashes(lines: DataFrame, tracked: int = 4096) -> DataFrame:
    """Hashes that may hold a large share of all lines: at most ``tracked`` rows.

    A mergeable heavy-hitter sketch finds every hash above about 1 / tracked of
    the rows. It only steers how rows are dealt out: a hash that it misses or
    reports in vain changes no result.
    """
    sketch = lines.agg(
        F.expr(f"approx_top_k(h1, {tracked // 2}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        sketch.select("n", F.explode("top").alias("entry"))
        .where(F.col("entry.count") > F.greatest(F.lit(100), F.col("n") / tracked))
        .select(F.col("entry.item").alias("hot"))
    )


def dropped_lines(docs: DataFrame, salts: int = 64) -> DataFrame:
    """``(doc, mark, pos)`` of every line that an earlier document holds too.

    Hashes are range-partitioned by (hash, salt); the salt is 0 but for hot
    hashes, which are split by document. Within a range, rows come in the order
    of hash, document and position, and the window streams each hash's first
    document. For hot hashes alone, the firsts of the salts are then compared:
    at most ``tracked * salts`` rows.
    """
    lines = materialise(line_hashes(docs))
    hot = F.broadcast(materialise(hot_hashes(lines)))  # at most 4,096 hashes
    salted = lines.join(hot, F.col("h1") == F.col("hot"), "left").withColumn(
        "salt",
        F.when(F.col("hot").isNull(), F.lit(0)).otherwise(
            1 + F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")
        ),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = salted.drop("hot").repartitionByRange(parts, "h1", "salt")
    streamed = Window.partitionBy("h1", "salt", "h2").orderBy("doc", "pos")
    first = ranges.withColumn("first", F.first("doc").over(streamed))
    cold = first.where("salt = 0 AND doc > first").select("doc", "mark", "pos")

    split = materialise(first.where("salt > 0").select("h1", "h2", "first", "doc", "mark", "pos"))
    firsts = split.groupBy("h1", "h2").agg(F.min("first").alias("least"))
    late = (
        split.join(F.broadcast(firsts), ["h1", "h2"])
        .where("doc > least")
        .select("doc", "mark", "pos")
    )
    return cold.unionByName(late)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """Per document that loses lines: ``(doc, mark, n_dropped, dropped)``.

    ``dropped`` is a sparse bitmap, a map from word number to the 64 bits of the
    lines it stands for; words without a dropped line are left out. The bits of a
    word are combined before they are shuffled.
    """
    words = (
        dropped_lines(docs)
        .groupBy("doc", "mark", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    )
    return words.groupBy("doc", "mark").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Every row stays. A null text counts as one empty line.
    """
    own = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "n_dropped", "dropped"
    )
    used = ["doc_id", "text"]
    joined = carried(docs, used).join(
        own,
        (_rank(F.col("doc_id")) == F.col("_doc")) & (_text_mark(F.col("text")) == F.col("_mark")),
        "left",
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    n_words = (F.size("_lines") + 63).cast("int") / 64
    dense = F.transform(
        F.sequence(F.lit(0), F.floor(n_words).cast("int")),
        lambda w: F.coalesce(F.element_at("dropped", w), F.lit(0).cast("long")),
    )
    kept = F.filter(
        "_lines",
        lambda _, i: F.getbit(F.get("_bits", (i / 64).cast("int")), i % 64) == 0,
    )
    staged = joined.withColumn("_lines", fenced(lines)).withColumn(
        "_bits", fenced(F.when(F.col("dropped").isNotNull(), dense))
    )
    return restored(
        staged,
        docs.columns,
        used,
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long")),
            "kept_text": F.when(F.col("_bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(
                F.array_join(kept, "\n")
            ),
        },
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove lines that an earlier document holds; see ``apply_bitmaps``.

    Keys of fewer than ten code points stay. The document with the smallest id
    keeps all its copies of a line. Rows of one id are one document; rows without
    an id are one document behind all others. An empty table gives no rows;
    existing columns ``n_lines``, ``n_dropped`` and ``kept_text`` are replaced.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs))
