"""Basket text files: one basket per line, items separated by commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_basket_text(baskets: DataFrame, path: str, items: str = "items") -> None:
    """Write one unquoted, comma-joined basket per line, in parallel part files.

    The format has no quoting: an item that holds a comma comes back as several
    items. Keep baskets as arrays unless another tool needs the text.
    """
    baskets.select(F.array_join(items, ",").alias("value")).write.mode("overwrite").text(path)


def read_basket_text(spark: SparkSession, path: str, items: str = "items") -> DataFrame:
    """Read basket text into arrays of distinct, trimmed, sorted items.

    Items that are empty after trimming are dropped; an empty line gives an
    empty basket and so still counts as a transaction.
    """
    parts = F.transform(F.split("value", ","), F.trim)
    return spark.read.text(path).select(
        F.array_sort(F.array_distinct(F.filter(parts, lambda item: item != ""))).alias(items)
    )
