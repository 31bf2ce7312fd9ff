"""Exact quantiles that do not gather a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.ordering import sorted_slices

_ACCURACY = 10_000
# The sketch is off by at most 1/accuracy of the rows; ask with room to spare.
_SLACK = 3.0 / _ACCURACY


def exact_quantiles(
    df: DataFrame,
    values: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Quantiles with linear interpolation, as rows ``(*by, variable, n, quantiles)``.

    ``percentile`` is exact too, but merges every distinct value of a group into
    one buffer. Here a mergeable sketch first brackets each quantile; one pass
    then counts what lies below the bracket and keeps values only inside it,
    at most about 0.1 % of the group. ``quantiles`` is an array in the order of
    ``probabilities``.

    ``few_groups`` says that ``by`` has a bounded number of values, such as
    segments or capped counts; the brackets are then broadcast. Without it Spark
    chooses the join, and AQE splits a hot group.
    """
    keys = [*by, "variable"]
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
                    for v in values
                ]
            )
        ).alias("_cell"),
    ).select(*by, "_cell.variable", "_cell.value")
    long = long.where("value IS NOT NULL")
    lows = [max(0.0, p - _SLACK) for p in probabilities]
    highs = [min(1.0, p + _SLACK) for p in probabilities]
    brackets = long.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", lows, _ACCURACY).alias("_low"),
        F.percentile_approx("value", highs, _ACCURACY).alias("_high"),
    )
    if not by or few_groups:
        brackets = F.broadcast(brackets)
    same_group = [long[k].eqNullSafe(brackets[f"_{k}"]) for k in keys]
    slots = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("slot"),
                    F.lit(float(p)).alias("p"),
                    F.col("_low")[i].alias("low"),
                    F.col("_high")[i].alias("high"),
                )
                for i, p in enumerate(probabilities)
            ]
        )
    ).alias("_slot")
    # Three kinds of row: 0 below the bracket, 1 inside it, 2 above it. Only kind
    # 1 keeps its value in the grouping key; the other two keep the value next to
    # the bracket, which may be the wanted one when the group is tiny.
    kind = (
        F.when(F.col("value") < F.col("_slot.low"), 0)
        .when(F.col("value") <= F.col("_slot.high"), 1)
        .otherwise(2)
    )
    counted = (
        long.join(brackets, same_group)
        .select(*keys, "n", "value", slots)
        .withColumn("_kind", kind)
        .groupBy(
            *keys,
            "n",
            F.col("_slot.slot").alias("slot"),
            F.col("_slot.p").alias("p"),
            "_kind",
            F.when(F.col("_kind") == 1, F.col("value")).alias("_inside"),
        )
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min("value").alias("_least"),
            F.max("value").alias("_greatest"),
        )
        .withColumn("value", F.when(F.col("_kind") == 0, F.col("_greatest")).otherwise(F.col("_least")))
    )
    # Values inside a bracket grow with the rows: they are sorted over range
    # partitions and counted within each, then shifted by the counts of earlier
    # partitions, so no group passes through one task.
    groups = [*keys, "slot"]
    slices = sorted_slices(counted, [*groups, "_kind", "value"])
    earlier = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        slices.groupBy("_slice", *groups)
        .agg(F.sum("_rows").alias("_total"))
        .select(
            F.col("_slice").alias("_of"),
            *[F.col(g).alias(f"_{g}_of") for g in groups],
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    same_slice = [F.col("_slice") == F.col("_of")]
    same_slice += [F.col(g).eqNullSafe(F.col(f"_{g}_of")) for g in groups]
    upto = (
        Window.partitionBy("_slice", *groups)
        .orderBy("_position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.col("p") * (F.col("n") - 1)
    low_rank, high_rank = F.floor(position) + 1, F.ceil(position) + 1
    ranked = slices.join(offsets, same_slice).withColumn(
        "_upto", F.col("_before") + F.sum("_rows").over(upto)
    )
    # A wanted rank deeper below or above would mean a broken sketch: fail, not guess.
    too_low = (F.col("_kind") == 0) & (F.col("_upto") > low_rank)
    too_high = (F.col("_kind") == 2) & (F.col("_upto") - F.col("_rows") + 1 < high_rank)
    guarded = F.when(
        too_low | too_high,
        F.raise_error(F.lit("quantile bracket misses its rank")).cast("double"),
    ).otherwise(F.col("value"))
    picked = (
        ranked.withColumn("_v", guarded)
        .groupBy(*keys, "n", "slot", "p")
        .agg(
            F.min(F.when(F.col("_upto") >= low_rank, F.col("_v"))).alias("_lo"),
            F.min(F.when(F.col("_upto") >= high_rank, F.col("_v"))).alias("_hi"),
        )
    )
    share = position - F.floor(position)
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share
    return (
        picked.withColumn("_point", F.struct("slot", point.alias("q")))
        .groupBy(*keys, "n")
        .agg(F.array_sort(F.collect_list("_point")).alias("_points"))
        .select(*keys, "n", F.transform("_points", lambda point: point["q"]).alias("quantiles"))
    )


def quantile_columns(quantiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """Spread the ``quantiles`` array over named columns."""
    return quantiles.select(
        *[c for c in quantiles.columns if c != "quantiles"],
        *[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)],
    )
