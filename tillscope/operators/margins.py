"""Margins of rules and baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.rules import items_in_rules, rule_items, rule_label


def item_margins_for(rules: DataFrame, margins: DataFrame) -> DataFrame:
    """Margins of the items that occur in the rules."""
    return margins.join(items_in_rules(rules), "item", "left_semi")


def _looked_up(pairs: DataFrame, margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        pairs.join(margins, "item", "left")
        .groupBy(*keys)
        .agg(
            F.sum("margin").alias("total_margin"),
            F.count(F.lit(1)).alias("_items"),
            F.count("margin").alias("_known"),
        )
    )


def margin_sums(pairs: DataFrame, margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of item margins per element; elements with an unknown item are left out.

    ``pairs`` has the key columns and one ``item`` per row, ``margins`` has
    ``(item, margin)``.
    """
    sums = _looked_up(pairs, margins, keys)
    return sums.where(F.col("_items") == F.col("_known")).select(*keys, "total_margin")


def margins_missing(pairs: DataFrame, margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The elements that ``margin_sums`` leaves out, with their unknown items counted."""
    sums = _looked_up(pairs, margins, keys)
    return sums.where(F.col("_items") > F.col("_known")).select(
        *keys, (F.col("_items") - F.col("_known")).alias("unknown_items")
    )


def rule_pairs(rules: DataFrame) -> DataFrame:
    """``(rule, item)`` rows of the rules, for the margin operators."""
    return rules.select(rule_label().alias("rule"), F.explode(rule_items()).alias("item"))


def basket_pairs(baskets: DataFrame) -> DataFrame:
    """``(order_id, item)`` rows of collected baskets."""
    return baskets.select("order_id", F.explode("items").alias("item"))


def rule_report(rules: DataFrame, margins: DataFrame) -> DataFrame:
    """Label, rounded quality measures and total margin of every priced rule."""
    totals = margin_sums(rule_pairs(rules), margins, ["rule"])
    return (
        rules.withColumn("rule", rule_label())
        .join(totals, "rule")
        .select(
            F.col("rule").alias("Rule"),
            F.round("support", 6).alias("Support"),
            F.round("confidence", 3).alias("Confidence"),
            F.round("lift", 2).alias("Lift"),
            F.round(F.round("total_margin", 10), 4).alias("Total_Margin"),
        )
    )


def rank_by_margin(report: DataFrame, n: int | None = None) -> DataFrame:
    ranked = report.orderBy(F.desc("Total_Margin"), "Rule")
    return ranked.limit(n) if n is not None else ranked


def business_score(report: DataFrame, n: int = 10) -> DataFrame:
    """The n rules with the largest lift x margin, from the rounded values."""
    return (
        report.select(
            "Rule",
            "Lift",
            "Total_Margin",
            (F.col("Lift") * F.col("Total_Margin")).alias("Business_Score"),
        )
        .orderBy(F.desc("Business_Score"), "Rule")
        .limit(n)
    )
