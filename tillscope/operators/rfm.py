"""Recency, frequency and monetary scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.quantiles import exact_quantiles, quantile_columns
from tillscope.session import materialise
from tillscope.sources.order_lines import VALUE

MEASURES = ("recency_days", "transaction_count", "amount")


class Segment(NamedTuple):
    """Inclusive score bounds of a named customer segment."""

    name: str
    recency: tuple[int, int]
    frequency: tuple[int, int]
    monetary: tuple[int, int]


# Segment names and score bounds, in matching order.
SEGMENTS = (
    Segment("Champions", (4, 5), (4, 5), (4, 5)),
    Segment("Loyal", (3, 5), (3, 5), (3, 5)),
    Segment("Potential", (1, 3), (1, 3), (2, 5)),
    Segment("At Risk", (1, 3), (1, 3), (2, 4)),
    Segment("Lost", (1, 3), (1, 4), (1, 4)),
    Segment("New", (5, 5), (1, 1), (1, 5)),
)
OTHERS = "Others"


def rfm_measures(
    lines: DataFrame, analysis_date: dt.date | str, grain: str = "line", value: str = VALUE
) -> DataFrame:
    """Days since the last purchase, transactions and amount per customer.

    ``grain="line"`` counts order lines as transactions, ``"order"`` distinct orders.
    """
    count = {
        "line": F.count(F.lit(1)),
        "order": F.count_distinct("order_id"),
    }[grain]
    return lines.groupBy("customer_id").agg(
        F.date_diff(F.lit(str(analysis_date)).cast("date"), F.max("date"))
        .cast("long")
        .alias("recency_days"),
        count.alias("transaction_count"),
        F.sum(value).alias("amount"),
    )


def score_measures(measures: DataFrame, bins: int = 5) -> DataFrame:
    """Scores 1..bins from quantile cuts, and the combined score.

    A bin holds its lower cut but not its upper one; the last also holds the
    maximum. Ties can leave bins empty, which equal-sized buckets would not. Low
    recency scores high. The cuts are one row and enter as a scalar subquery.

    The measures, one row per customer, are materialised: the cuts and the scores
    read them and not the lines again.
    """
    measures = materialise(measures)
    inner = [i / bins for i in range(1, bins)]
    cuts = exact_quantiles(measures, MEASURES, inner).agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "quantiles"))).alias("cuts")
    )
    cut_table = F.col("_cuts")

    def cuts_passed(name: str) -> Column:
        at = cut_table[name]
        passed = [(F.col(name) >= at[i]).cast("int") for i in range(bins - 1)]
        return sum(passed[1:], passed[0])

    return (
        measures.withColumn("_cuts", cuts.scalar())
        .withColumns(
            {
                "recency_score": F.lit(bins) - cuts_passed("recency_days"),
                "frequency_score": cuts_passed("transaction_count") + 1,
                "monetary_score": cuts_passed("amount") + 1,
            }
        )
        .withColumn(
            "rfm_score",
            F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score"),
        )
        .drop("_cuts")
    )


def rfm_table(
    lines: DataFrame,
    analysis_date: dt.date | str,
    bins: int = 5,
    grain: str = "line",
    value: str = VALUE,
) -> DataFrame:
    """One row per customer: measures, their scores and the combined score."""
    return score_measures(rfm_measures(lines, analysis_date, grain, value), bins)


def assign_segments(rfm: DataFrame, segments: Sequence[Segment] = SEGMENTS) -> DataFrame:
    """Add ``segment``: the first segment whose bounds hold all three scores."""
    label = F.lit(OTHERS)
    for segment in reversed(segments):
        inside = (
            F.col("recency_score").between(*segment.recency)
            & F.col("frequency_score").between(*segment.frequency)
            & F.col("monetary_score").between(*segment.monetary)
        )
        label = F.when(inside, F.lit(segment.name)).otherwise(label)
    return rfm.withColumn("segment", label)


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Customers, orders, revenue and average order value per segment."""
    return (
        segmented.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("transaction_count").alias("orders"),
            F.sum("amount").alias("revenue"),
        )
        .withColumn("aov", F.try_divide("revenue", "orders"))
    )


def segment_medians(segmented: DataFrame) -> DataFrame:
    """Median of every measure per segment."""
    long = quantile_columns(
        exact_quantiles(segmented, MEASURES, [0.5], by=["segment"], few_groups=True), ["median"]
    )
    return long.groupBy("segment").agg(
        *[
            F.max(F.when(F.col("variable") == m, F.col("median"))).alias(f"median_{m}")
            for m in MEASURES
        ]
    )


def score_heatmap(rfm: DataFrame) -> DataFrame:
    """Mean amount by recency and frequency score."""
    return rfm.groupBy("recency_score", "frequency_score").agg(
        F.avg("amount").alias("mean_amount")
    )


def score_distribution(rfm: DataFrame) -> DataFrame:
    """Customers by recency, frequency and monetary score."""
    return rfm.groupBy("recency_score", "frequency_score", "monetary_score").agg(
        F.count(F.lit(1)).alias("customers")
    )
