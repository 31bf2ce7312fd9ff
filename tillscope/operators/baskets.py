"""Baskets: the distinct items of each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "product_title"
ORDER = "order_id"


def order_items(lines: DataFrame, item: str = ITEM, order: str = ORDER) -> DataFrame:
    """Distinct ``(order_id, item)`` pairs.

    The shuffle key holds both columns, so even an order with a third of all
    lines is spread over the cluster. Lines without an item are no part of a basket.
    """
    pairs = lines.select(F.col(order).alias("order_id"), F.col(item).alias("item"))
    return pairs.where("item IS NOT NULL").distinct()


def collect_baskets(lines: DataFrame, item: str = ITEM, order: str = ORDER) -> DataFrame:
    """One row per order with its distinct items, sorted.

    One shuffle: repeats are gone before it, since a task sends each order once with
    the distinct items that it has seen, so an array is never longer than the
    catalogue. Titles are never split, whatever they contain.
    """
    pairs = lines.select(F.col(order).alias("order_id"), F.col(item).alias("item"))
    return (
        pairs.where("item IS NOT NULL")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def baskets_of(pairs: DataFrame) -> DataFrame:
    """Gather ``(order_id, item)`` pairs into one sorted array per order."""
    return pairs.groupBy("order_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def collapse_items(lines: DataFrame, item: str = ITEM, order: str = ORDER) -> DataFrame:
    """Join all titles of an order, repeats included, into one sorted text.

    Repeats travel as a count and are written out only in the final text.
    """
    counted = lines.groupBy(F.col(order).alias("order_id"), F.col(item).alias("item")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    gathered = counted.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("item", "n"))).alias("_items")
    )
    repeated = F.flatten(F.transform("_items", lambda e: F.array_repeat(e["item"], e["n"])))
    return gathered.select("order_id", F.array_join(repeated, ",").alias("items"))


def count_baskets(pairs: DataFrame) -> DataFrame:
    """The number of baskets as one row.

    Counts the pairs of each order on the way. A distinct count of orders would
    drop the item column and so could not share the shuffle that made the pairs.
    """
    sizes = pairs.groupBy("order_id").agg(F.count("item").alias("_size")).where("_size > 0")
    return sizes.agg(F.count(F.lit(1)).alias("n_baskets"))


def frequent_items(pairs: DataFrame, min_support: float) -> DataFrame:
    """Items in at least ``ceil(min_support * baskets)`` baskets, with counts.

    At most (mean basket size / min_support) rows, whatever the number of
    baskets, which is what makes this table safe to broadcast.
    """
    threshold = F.ceil(F.lit(min_support) * count_baskets(pairs).scalar())
    return (
        pairs.groupBy("item")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= threshold)
    )


def frequent_baskets(pairs: DataFrame, min_support: float) -> DataFrame:
    """Baskets reduced to frequent items; emptied baskets stay and still count.

    An infrequent item is in no frequent itemset, so mining loses nothing, and
    basket length is bounded by the number of frequent items.
    """
    frequent = F.broadcast(
        frequent_items(pairs, min_support).select(F.col("item").alias("_frequent"))
    )
    return (
        pairs.join(frequent, pairs["item"] == frequent["_frequent"], "left")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list("_frequent")).alias("items"))
    )


def count_pairs(baskets: DataFrame) -> DataFrame:
    """``(item_a, item_b, count)``: baskets that hold both items, from sorted arrays ``items``.

    Pairs are counted where they arise, before any shuffle.
    """
    first = baskets.select("items", F.posexplode("items").alias("_at", "item_a"))
    later = F.slice("items", F.col("_at") + 2, F.size("items"))
    return (
        first.select("item_a", F.explode(later).alias("item_b"))
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def cooccurring_pairs(pairs: DataFrame, min_support: float) -> DataFrame:
    """Item pairs that share at least the minimum number of baskets.

    Both items of such a pair are frequent, so only frequent items are paired.
    """
    threshold = F.ceil(F.lit(min_support) * count_baskets(pairs).scalar())
    return count_pairs(frequent_baskets(pairs, min_support)).where(F.col("count") >= threshold)


def basket_summary(pairs: DataFrame, top: int = 5) -> DataFrame:
    """Baskets, items, density, top items and basket sizes as ``(metric, value)``.

    Sizes collapse to a table of size counts (bounded by the catalogue) before
    any statistic is taken.
    """
    sizes = (
        pairs.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The filter keeps the count in the plan, and with it the shared shuffle.
    items = pairs.groupBy("item").agg(F.count("order_id").alias("n")).where("n > 0")
    quartiles = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    basket_side = sizes.agg(
        F.sum("n").alias("baskets"),
        F.sum(F.col("size") * F.col("n")).alias("cells"),
        F.min("size").alias("size_min"),
        F.max("size").alias("size_max"),
        quartiles.alias("_q"),
    ).withColumn("items", items.agg(F.count(F.lit(1)).alias("items")).scalar())
    metrics = {
        "baskets": F.col("baskets"),
        "items": F.col("items"),
        "density": F.col("cells") / (F.col("baskets") * F.col("items")),
        "size_min": F.col("size_min"),
        "size_q1": F.col("_q")[0],
        "size_median": F.col("_q")[1],
        "size_mean": F.col("cells") / F.col("baskets"),
        "size_q3": F.col("_q")[2],
        "size_max": F.col("size_max"),
    }
    overall = basket_side.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
                    for name, value in metrics.items()
                ]
            )
        )
    )
    by_size = sizes.select(
        F.concat(F.lit("size="), F.col("size").cast("string")).alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    favourites = (
        items.orderBy(F.desc("n"), "item")
        .limit(top)
        .select(
            F.concat(F.lit("item="), "item").alias("metric"),
            F.col("n").cast("double").alias("value"),
        )
    )
    return overall.unionByName(by_size).unionByName(favourites)
