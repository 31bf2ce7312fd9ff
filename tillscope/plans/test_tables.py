"""The test tables as order lines: trusted keys, repeatable dirt, item margins.

The tables obey their foreign keys (``tests/test_queries.py`` checks it), so the
catalogue opts in to leaving out joins that only check a key.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources import order_lines as source
from tillscope.sources.order_lines import COLUMNS, VALUE, line_column, star, table

order_lines = partial(source.order_lines, rely_on_keys=True)


def raw_order_lines(
    spark: SparkSession,
    root: str,
    columns: Iterable[str] | None = None,
    rely_on_keys: bool = True,
) -> DataFrame:
    """The same view with repeatable dirt, as input for the cleaning operators.

    Dates are day-month-year text with three kinds of separators, some zip codes and titles are missing, some
    group labels have the wrong case and some values are not positive.
    """
    names = tuple(columns) if columns is not None else COLUMNS
    joined = star(spark, root, set(names), rely_on_keys)
    dirty = {
        "date": lambda: F.when(
            F.col("l_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")
        )
        .when(F.col("l_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "d/M/yyyy")),
        "customer_zip_code": lambda: F.when(
            F.col("l_orderkey") % 50 != 0, line_column("customer_zip_code")
        ),
        "product_title": lambda: F.when(F.col("l_orderkey") % 77 != 3, F.col("p_name")),
        "product_group_level_1": lambda: F.when(
            F.col("l_partkey") % 10 == 0, F.lower("p_type")
        ).otherwise(F.col("p_type")),
        VALUE: lambda: F.when(F.col("l_discount") >= 0.095, -1.0)
        .when((F.col("l_tax") == 0) & (F.col("l_quantity") <= 2), 0.0)
        .otherwise(line_column(VALUE)),
    }
    return joined.select(
        *[dirty.get(name, lambda n=name: line_column(n))().alias(name) for name in names]
    )


def item_margins(spark: SparkSession, root: str) -> DataFrame:
    """A margin per item title, derived from discounts."""
    lines = table(spark, root, "lineitem")
    part = table(spark, root, "part")
    # Sum per part first: the join and the second grouping then see one row per
    # part and not one per line.
    per_part = lines.groupBy("l_partkey").agg(
        F.sum("l_discount").alias("discount"), F.count("l_discount").alias("n")
    )
    return (
        per_part.join(part, per_part.l_partkey == part.p_partkey)
        .groupBy(F.col("p_name").alias("item"))
        .agg(F.sum("discount").alias("discount"), F.sum("n").alias("n"))
        .select("item", (0.30 + 200 * (F.col("discount") / F.col("n") - 0.05)).alias("margin"))
    )
