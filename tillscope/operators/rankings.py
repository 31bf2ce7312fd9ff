"""Revenue leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.ordering import top_k
from tillscope.sources.order_lines import VALUE


def top_by_value(lines: DataFrame, key: str, name: str, k: int = 10) -> DataFrame:
    """The k values of ``key`` with the largest summed order value."""
    totals = lines.groupBy(key).agg(F.sum(VALUE).alias(name))
    return top_k(totals, k, name, key)


def top_customers(lines: DataFrame, k: int = 10) -> DataFrame:
    return top_by_value(lines, "customer_id", "total_spend", k)


def top_products(lines: DataFrame, k: int = 10) -> DataFrame:
    return top_by_value(lines, "product_title", "total_revenue", k)


def top_categories(lines: DataFrame, k: int = 10) -> DataFrame:
    return top_by_value(lines, "product_group_level_1", "total_revenue", k)
