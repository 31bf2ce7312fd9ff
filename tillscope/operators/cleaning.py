"""Cleaning of raw order lines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.ordering import row_index
from tillscope.session import materialise
from tillscope.sources.order_lines import VALUE

GROUP = "product_group_level_1"
CATEGORY = "product_category_level_2"

# Fixed value: the one misspelt group label and its right form.
LABEL_FIXES = {"Bed linen": "Bed Linen"}

# The day-month-year text format (single digits are accepted), and
# the separators that stand for its dot.
DATE_FORMAT = "d.M.yyyy"
DATE_SEPARATORS = "-/"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop every row with a missing value in any column."""
    return df.dropna("any")


def fix_labels(df: DataFrame, column: str, fixes: Mapping[str, str] = LABEL_FIXES) -> DataFrame:
    """Replace the given labels and leave all others as they are."""
    label = F.col(column)
    for wrong, right in fixes.items():
        label = F.when(F.col(column) == wrong, F.lit(right)).otherwise(label)
    return df.withColumn(column, label)


def fix_labels_from(df: DataFrame, column: str, fixes: DataFrame) -> DataFrame:
    """``fix_labels`` with the replacements in a table ``(wrong, right)``."""
    return (
        df.join(fixes, df[column] == fixes["wrong"], "left")
        .withColumn(column, F.coalesce("right", column))
        .drop("wrong", "right")
    )


def parse_date(column: str | Column, fmt: str = DATE_FORMAT) -> Column:
    """Text to date; text that does not parse becomes null.

    Separators may be dots, hyphens or slashes.
    """
    dotted = F.translate(column, DATE_SEPARATORS, "." * len(DATE_SEPARATORS))
    return F.try_to_date(dotted, fmt)


def to_number(column: str | Column) -> Column:
    """Text to double; text that does not parse becomes null."""
    value = F.col(column) if isinstance(column, str) else column
    return value.try_cast("double")


def keep_positive(df: DataFrame, column: str = VALUE) -> DataFrame:
    return df.where(F.col(column) > 0)


def factor_codes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Add ``<column>_code``: the 1-based rank of the label among sorted labels.

    The distinct labels of all columns come from one pass; only they are ranked
    (and materialised, see ``row_index``). The codes come back by equi joins.
    """
    columns = list(columns)
    labels = df.unpivot([], columns, "_variable", "_label").where("_label IS NOT NULL").distinct()
    ranked = row_index(labels, ["_variable", "_label"], name="_id")
    starts = ranked.groupBy("_variable").agg(F.min("_id").alias("_start"))  # one row per column
    codes = materialise(
        ranked.join(F.broadcast(starts), "_variable").select(
            "_variable", "_label", (F.col("_id") - F.col("_start") + 1).alias("_code")
        )
    )
    for column in columns:
        own = codes.where(F.col("_variable") == column).select(
            "_label", F.col("_code").alias(f"{column}_code")
        )
        df = df.join(own, df[column] == own["_label"], "left").drop("_label")
    return df


def clean_order_lines(
    df: DataFrame, label_fixes: Mapping[str, str] | None = LABEL_FIXES
) -> DataFrame:
    """Fix labels, drop incomplete rows, parse dates, keep positive values.

    Pass ``label_fixes=None`` for the variant without the label step.
    """
    if label_fixes:
        df = fix_labels(df, GROUP, label_fixes)
    return (
        df.transform(drop_incomplete)
        .withColumn("date", parse_date("date"))
        .transform(keep_positive)
        .withColumn("customer_id", F.col("customer_id").cast("string"))
    )


def clean_for_baskets(df: DataFrame, label_fixes: Mapping[str, str] = LABEL_FIXES) -> DataFrame:
    """Drop incomplete rows, derive the basket columns, then fix the label.

    Two differences from ``clean_order_lines`` are intended: non-positive values
    stay, and ``product_group`` is copied before the fix and keeps the old label.
    """
    complete = df.transform(drop_incomplete)
    derived = complete.withColumns(
        {
            "date": parse_date("date"),
            "order_id": F.col("order_id").cast("string"),
            "customer_id": F.col("customer_id").cast("string"),
            "product_id": F.col("product_id").cast("string"),
            "price": to_number(VALUE),
            "product": F.col("product_title").cast("string"),
            "zip_code": F.col("customer_zip_code").cast("string"),
            "product_group": F.col(GROUP),
            "product_category": F.col(CATEGORY),
        }
    )
    return fix_labels(derived, GROUP, label_fixes)
