"""Near duplicates by SimHash with deletion-variant signatures.

Fingerprints of 64 bits link at 3 or fewer differing bits. Cut into two segments,
one of them then differs by at most one bit, so two linked fingerprints share a
segment variant with one wildcard bit, or a whole segment. Variants are joined by
equality and verified. A bucket that many fingerprints share is not paired: its
members are linked through the fingerprints around them (``_crowded_links``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import apart, carried, restored
from tillscope.llm.components import connected_components
from tillscope.session import materialise, ship_package

# Fingerprint size, link distance, hash seed.
BITS = 64
MAX_DISTANCE = 3
SEED = 42

_HALF = BITS // 2


def fingerprint(text: str | None, width: int, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as an unsigned integer.

    A-Z count as a-z; words are split at ASCII white space. Fewer than ``width``
    words form one shingle, none at all give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())),
        np.uint64,
        len(starts),
    )
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):  # 8 bytes become 64 flags
        block = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The long ``keys`` and ``fp`` of every row; ``fp`` is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    names = [*keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), width) for t in batch.column("text")),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keys), pa.array(found.view(np.int64))], names
            )

    return docs.select(
        *[F.col(c).cast("long") for c in keys], F.col("text").cast("string")
    ).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _mask(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def _variants(values: DataFrame, bit: int) -> DataFrame:
    """``(key, wild, fp)``: the one-wildcard variants of both segments.

    A variant stands on the side of its wildcard bit's value (``bit``), so two
    fingerprints meet there only if they differ in that bit; equal segments meet
    under the whole segment, which stands on both sides. The key packs segment
    number, wildcard position (32: none) and the other bits.
    """
    positions = F.sequence(F.lit(0), F.lit(_HALF))

    def of_segment(number: int) -> Column:
        segment = F.shiftrightunsigned("fp", number * _HALF).bitwiseAND(F.lit((1 << _HALF) - 1))

        def stands(p: Column) -> Column:
            is_set = F.when(p < _HALF, segment.bitwiseAND(_mask(p)) != 0)
            return (p == _HALF) | (is_set == F.lit(bool(bit)))

        def key(p: Column) -> Column:
            rest = F.when(p == _HALF, segment).otherwise(
                segment.bitwiseAND(F.bitwise_not(_mask(p)))
            )
            place = F.call_function(
                "shiftleft", (p + number * (_HALF + 1)).cast("long"), F.lit(_HALF)
            )
            return F.struct(rest.bitwiseOR(place).alias("key"), (p != _HALF).alias("wild"))

        return F.transform(F.filter(positions, stands), key)

    return values.select("fp", F.explode(F.concat(of_segment(0), of_segment(1))).alias("v")).select(
        "v.key", "v.wild", "fp"
    )


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def _crowded_links(crowd: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that connect all linked members of ``crowd(fp)``.

    Without pairing them: fingerprints that are at most two bits apart share a
    value at distance 0 or 1 from both, and all that share one are at most two
    bits apart, so each links to the least of them. Three bits apart, one side has
    an even and one an odd number of set bits, and two of the three bits lie in
    the same half: the odd side names its 64 values at distance 1, the even side
    its 992 values that differ by two bits in one half, and equal values link the
    even side to the least odd one. About 600 rows per member, however many there
    are in one place.
    """
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    near = crowd.select(
        "fp",
        F.explode(
            F.concat(
                F.array("fp"), F.transform(bits, lambda b: F.col("fp").bitwiseXOR(_mask(b)))
            )
        ).alias("at"),
    )
    around = near.groupBy("at").agg(
        F.min("fp").alias("least"),
        F.min(F.when((F.bit_count("fp") % 2 == 1) & (F.col("fp") != F.col("at")), F.col("fp"))).alias(
            "least_odd"
        ),
        F.count(F.lit(1)).alias("n"),
    )
    around = materialise(around)
    two = near.join(
        around.where("n > 1").select("at", "least"), "at"
    ).where("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst"))
    flips = F.flatten(
        F.transform(
            bits,
            lambda a: F.transform(
                F.sequence(a, F.when(a < _HALF, _HALF - 1).otherwise(BITS - 1)),
                lambda b: F.when(
                    a < b, F.col("fp").bitwiseXOR(_mask(a)).bitwiseXOR(_mask(b))
                ),
            ),
        )
    )
    far = crowd.where(F.bit_count("fp") % 2 == 0).select(
        "fp", F.explode(F.array_compact(flips)).alias("at")
    )
    three = far.join(
        around.where("least_odd IS NOT NULL").select("at", "least_odd"), "at"
    ).select(F.col("fp").alias("src"), F.col("least_odd").alias("dst"))
    return two.unionByName(three).distinct()


def links(values: DataFrame, crowd_size: int = 256) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints ``values(fp)``.

    Every pair at ``MAX_DISTANCE`` bits or less is connected by them, directly or
    through other links. A bucket of up to ``crowd_size`` variants is joined and
    each pair verified, which bounds the pairs per variant; the members of larger
    ones also go through ``_crowded_links``.
    """
    zeros, ones = _variants(values, 0), _variants(values, 1)
    sizes = (
        zeros.unionByName(ones.where("wild"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > crowd_size)
    )
    crowded = materialise(sizes.select(F.col("key").alias("_key")))
    on = F.col("key") == F.col("_key")
    left = zeros.join(crowded, on, "left_anti").select("key", "wild", F.col("fp").alias("src"))
    right = ones.join(crowded, on, "left_anti").select(
        F.col("key").alias("key2"), F.col("fp").alias("dst")
    )
    sparse = (
        left.join(right, F.col("key") == F.col("key2"))
        .where((F.col("wild") | (F.col("src") < F.col("dst"))) & _close("src", "dst"))
        .select("src", "dst")
    )
    members = (
        zeros.unionByName(ones.where("wild")).join(crowded, on, "left_semi").select("fp").distinct()
    )
    crowd = materialise(members)
    if crowd.isEmpty():
        return sparse
    return sparse.unionByName(_crowded_links(crowd))


def _grouped(classes: DataFrame) -> DataFrame:
    """``classes(fp, ...)`` with the ``root`` of the component of each fingerprint."""
    roots = connected_components(links(classes.select("fp")))
    return materialise(
        classes.join(roots, F.col("fp") == F.col("node"), "left").select(
            *classes.columns, F.coalesce("root", "fp").alias("root")
        )
    )


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints are taken over shingles of ``width`` words. ``component_id`` is
    the smallest doc_id reachable over links. Equal fingerprints form one class
    before anything is joined, so copies are never paired. Null and empty texts
    have fingerprint 0 and link like any other. A row without an id belongs to its
    component but never names it; a component of such rows alone has a null id.
    Repeated rows come back repeated.
    """
    marked = materialise(fingerprints(docs, width))
    rooted = _grouped(materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select(apart(F.col("root")).alias("_root"), "component_id")
    labels = rooted.join(named, F.col("root") == F.col("_root")).select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``; all columns stay.

    The document with the smallest id stays, rows without an id behind all others
    and, among those, the one with the least hash of its text; of repeated rows one
    stays. Null and empty texts are equal to each other and link like any other.
    An empty table gives no rows.
    """

    def keyed(df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
        return df.withColumns(
            {"doc": rank, "m1": F.xxhash64(text), "m2": F.xxhash64(F.lit(1), text)}
        )

    key = ["doc", "m1", "m2"]
    whole = keyed(docs.select("doc_id", "text")).select(*key, "text")
    marked = materialise(fingerprints(whole, width, key))
    row = F.struct(*key)
    rooted = _grouped(materialise(marked.groupBy("fp").agg(F.min(row).alias("first"))))
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    stays = materialise(stays.select(*[F.col(c).alias(f"_{c}") for c in key]))
    same = (F.col("doc") == F.col("_doc")) & (F.col("m1") == F.col("_m1")) & (F.col("m2") == F.col("_m2"))
    used = ["doc_id", "text"]
    kept = keyed(carried(docs, used)).join(stays, same, "left_semi")
    twice = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialise(twice.select(*[F.col(c).alias(f"_{c}") for c in key]))
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(
            kept.join(twice, same, "left_semi").dropDuplicates(key)
        )
    return restored(kept, docs.columns, used, {})
