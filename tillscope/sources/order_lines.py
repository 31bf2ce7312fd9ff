"""The order-line table: schema, readers and the view over a star schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_LINE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("customer_zip_code", T.StringType()),
        T.StructField("product_group_level_1", T.StringType()),
        T.StructField("product_category_level_2", T.StringType()),
        T.StructField("order_value_ex_vat_ex_freight", T.DoubleType()),
    ]
)
COLUMNS = tuple(ORDER_LINE_SCHEMA.names)
VALUE = "order_value_ex_vat_ex_freight"

# The same columns before cleaning: the date is still day-month-year text.
RAW_ORDER_LINE_SCHEMA = T.StructType(
    [T.StructField("date", T.StringType()), *ORDER_LINE_SCHEMA.fields[1:]]
)

_FROM_ORDERS = {"date", "customer_id", "customer_zip_code"}
_FROM_CUSTOMER = {"customer_zip_code"}
_FROM_PART = {"product_title", "product_group_level_1", "product_category_level_2"}


def read_order_lines(
    spark: SparkSession, path: str, fmt: str = "parquet", raw: bool = False, **options: str
) -> DataFrame:
    """Read a flat order-line table with a fixed schema (no inference pass)."""
    schema = RAW_ORDER_LINE_SCHEMA if raw else ORDER_LINE_SCHEMA
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def star(spark: SparkSession, root: str, wanted: set[str], rely_on_keys: bool) -> DataFrame:
    """Line items joined with the dimensions that ``wanted`` needs.

    A dimension that gives no wanted column could only remove lines whose key it
    lacks. With ``rely_on_keys`` the tables are trusted to obey their foreign
    keys and that join, a shuffle of all lines, is left out; otherwise it stays
    as a semi join. Join strategy is left to Spark: it broadcasts a side only
    below its size threshold, and AQE splits a partition that one hot key fills.
    """
    lines = table(spark, root, "lineitem")
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer")
    part = table(spark, root, "part")

    if wanted & _FROM_CUSTOMER:
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
    elif not rely_on_keys:
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left_semi")
    if wanted & _FROM_ORDERS:
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    elif not rely_on_keys:
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_semi")
    if wanted & _FROM_PART:
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
    elif not rely_on_keys:
        lines = lines.join(part, lines.l_partkey == part.p_partkey, "left_semi")
    return lines


def line_column(name: str) -> Column:
    return {
        "date": lambda: F.col("o_orderdate").cast("date"),
        "order_id": lambda: F.col("l_orderkey").cast("string"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "product_id": lambda: F.col("l_partkey").cast("string"),
        "product_title": lambda: F.col("p_name"),
        "customer_zip_code": lambda: F.col("c_nationkey").cast("string"),
        "product_group_level_1": lambda: F.col("p_type"),
        "product_category_level_2": lambda: F.col("p_brand"),
        VALUE: lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }[name]()


def order_lines(
    spark: SparkSession,
    root: str,
    columns: Iterable[str] | None = None,
    rely_on_keys: bool = False,
) -> DataFrame:
    """The order-line view over lineitem, orders, customer and part."""
    names = tuple(columns) if columns is not None else COLUMNS
    joined = star(spark, root, set(names), rely_on_keys)
    return joined.select(*[line_column(name).alias(name) for name in names])
