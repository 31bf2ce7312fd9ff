"""Carry a table's other columns through an operator without name clashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame, used: Sequence[str]) -> DataFrame:
    """The ``used`` columns, and all others in one struct ``_row``."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*used, (F.struct(*others) if others else F.lit(None)).alias("_row"))


def restored(
    df: DataFrame, columns: Sequence[str], used: Sequence[str], new: Mapping[str, Column]
) -> DataFrame:
    """``columns`` as they were before ``carried``, replaced or followed by ``new``."""
    kept = [
        (F.col(c) if c in used else F.col("_row").getField(c)).alias(c)
        for c in columns
        if c not in new
    ]
    return df.select(*kept, *[value.alias(name) for name, value in new.items()])


def apart(key: Column) -> Column:
    """A long key as a new expression, for joining a table back to what it was grouped from.

    Grouped by the very key, the table would keep that grouping for the join, and
    a hot key's rows on the other side would all have to come to it. Dealt out
    anew, both sides are plain shuffles, and AQE splits the hot key.
    """
    return F.bitwise_not(F.bitwise_not(key))
