"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import apart
from tillscope.session import scratch_path


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: neighbours of a node are linked to its least neighbour.

    The least neighbour is an aggregate that is combined before the shuffle, and
    comes back to the edges by a plain join, whose hot keys AQE splits: no node's
    neighbours are gathered.
    """
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.select(apart(F.col("src")).alias("_node"), F.least("src", "least").alias("least"))
    moved = edges.join(least, F.col("src") == F.col("_node"))
    if larger_only:
        return moved.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(
        least.select(F.col("_node").alias("src"), F.col("least").alias("dst"))
    )


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a new table in the shared folder, read back.

    Unlike a checkpoint, the table brings nothing of its history along: what the
    optimiser keeps about a frame would otherwise grow from round to round.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(src, dst)``, both long and not null.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until
    the edges no longer change; the root is the least node. Each step is written
    to the shared folder, so that a lost executor costs one step and every round
    plans alike. An empty edge table gives no rows; no end within ``max_rounds``
    raises.
    """
    current = _written(
        edges.select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        )
        .where("src <> dst")
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        mark = current.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.hash("src", "dst"))
        ).first()
        if tuple(mark) == before:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
            )
        before = tuple(mark)
        large = _to_least(_both_ways(current), larger_only=True).where("src <> dst").distinct()
        large = _written(large, "large-star")
        small = _to_least(large, larger_only=False).where("src <> dst").distinct()
        current = _written(small, "small-star")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
