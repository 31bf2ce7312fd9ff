"""Profiles and summaries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.quantiles import exact_quantiles, quantile_columns


def _rows(structs: Sequence[Column]) -> Column:
    """Turn one aggregated row into one row per struct."""
    return F.inline(F.array(*structs))


def schema_profile(df: DataFrame) -> DataFrame:
    """Position, name and type of every column, with the table's row count."""
    fields = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
        )
        for i, field in enumerate(df.schema.fields, start=1)
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(_rows(fields))


def missing_total(df: DataFrame) -> DataFrame:
    """The number of missing cells in the whole table."""
    gone = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return df.agg(sum(gone[1:], gone[0]).alias("missing_cells"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and share per column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).alias("missing"),
            F.try_divide(F.col(c), F.col("_n")).alias("share"),
        )
        for c in df.columns
    ]
    return counts.select(_rows(cells))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum per column."""
    spread = quantile_columns(
        exact_quantiles(df, columns, [0.25, 0.5, 0.75]), ["q1", "median", "q3"]
    )
    moments = df.agg(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.min(c).cast("double").alias("min"),
                F.avg(c).alias("mean"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).select(_rows([F.col(c) for c in columns]))
    return (
        moments.join(spread, "variable")
        .select("variable", "min", "q1", "median", "mean", "q3", "max")
    )


def factor_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every level of the given label columns."""
    return (
        df.unpivot([], list(columns), "variable", "level")
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as ``(row, col, r)``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one_row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [(a, b, F.col(f"`{a}|{b}`")) for a, b in pairs]
    cells += [(b, a, r) for a, b, r in cells]
    cells += [(c, c, F.lit(1.0)) for c in columns]
    return one_row.select(
        _rows(
            [
                F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), r.alias("r"))
                for a, b, r in cells
            ]
        )
    )
