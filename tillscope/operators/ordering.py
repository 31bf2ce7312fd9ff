"""Order-dependent operators without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import materialise

_POSITION_BITS = 33  # monotonically_increasing_id keeps the position in the low bits


def sorted_slices(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in global order, materialised, with slice number and position.

    ``orderBy`` gives range partitions. They are checkpointed, so the slice
    number and the position within the slice stay the same for every later read.
    """
    mark = F.monotonically_increasing_id()
    return materialise(
        df.orderBy(*order)
        .withColumn("_mark", mark)
        .withColumn("_slice", F.shiftright("_mark", _POSITION_BITS))
        .withColumn("_position", F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_mark")
    )


def _with_offsets(slices: DataFrame, **totals: Column) -> DataFrame:
    """Join each slice with the given totals summed over all earlier slices.

    The per-slice table has one row per partition, so the ordered window over it
    and its broadcast are bounded by the partition count, not by the data.
    """
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = slices.groupBy("_slice").agg(*[t.alias(name) for name, t in totals.items()])
    offsets = per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals],
    )
    return slices.join(F.broadcast(offsets), "_slice")


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Number the rows 1..n in the given order (materialises the sorted rows).

    Range partitions are numbered on their own and shifted by the row counts of
    the partitions before them; no row passes through a single task.
    """
    slices = sorted_slices(df, order)
    return _with_offsets(slices, _rows_before=F.count(F.lit(1))).select(
        *df.columns, (F.col("_rows_before") + F.col("_position") + 1).alias(name)
    )


def running_prior_ratio(
    df: DataFrame, order: Sequence[str | Column], value: str, name: str = "ratio"
) -> DataFrame:
    """Each value divided by the sum of all earlier values; the first row by 1.

    Partition totals are shifted as in ``row_index``; the running window works
    within one range partition at a time.
    """
    slices = sorted_slices(df, order)
    within = (
        Window.partitionBy("_slice")
        .orderBy("_position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    prior = F.col("_sum_before") + F.coalesce(F.sum(value).over(within), F.lit(0.0))
    is_first = F.col("_rows_before") + F.col("_position") == 0
    return (
        _with_offsets(slices, _rows_before=F.count(F.lit(1)), _sum_before=F.sum(value))
        .withColumn("_prior", F.when(is_first, F.lit(1.0)).otherwise(prior))
        .select(*df.columns, F.try_divide(F.col(value), F.col("_prior")).alias(name))
    )


def top_k(df: DataFrame, k: int, value: str | Column, *ties: str | Column) -> DataFrame:
    """The k rows with the largest value (nulls last), ties in ascending order."""
    value = F.col(value) if isinstance(value, str) else value
    return df.orderBy(value.desc_nulls_last(), *ties).limit(k)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 123) -> DataFrame:
    """A sample of ``min(n, count)`` rows without replacement, by a unique key.

    Rows are ranked by the md5 of key and seed, so the sample does not depend on
    the partitioning. The first four hex digits split the rows into 65,536 even
    buckets: whole buckets are taken while they fit, and only the bucket on the
    boundary, 1/65,536 of the rows, is sorted.
    """
    ranked = df.withColumn(
        "_rank_key", F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    ).withColumn("_bucket", F.substring("_rank_key", 1, 4))
    sizes = ranked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
    boundary = sizes.where((F.col("_before") < n) & (F.col("_before") + F.col("_size") > n))
    # No boundary bucket: either everything fits or n falls between two buckets.
    edge = boundary.agg(
        F.struct(F.max("_bucket").alias("bucket"), F.max("_before").alias("before")).alias("edge")
    )
    whole = sizes.where(F.col("_before") + F.col("_size") <= n).agg(F.max("_bucket").alias("last"))
    marked = ranked.withColumn("_edge", edge.scalar()).withColumn("_last", whole.scalar())
    taken = marked.where(F.col("_bucket") <= F.col("_last"))
    by_key = Window.partitionBy("_bucket").orderBy("_rank_key", key)
    partly = (
        marked.where(F.col("_bucket") == F.col("_edge.bucket"))
        .withColumn("_place", F.row_number().over(by_key))
        .where(F.col("_place") <= n - F.col("_edge.before"))
    )
    return taken.select(*df.columns).unionByName(partly.select(*df.columns))
