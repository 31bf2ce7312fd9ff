"""Frequent itemsets level by level, so that a length limit bounds the work."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.baskets import count_baskets
from tillscope.operators.ordering import row_index
from tillscope.operators.rules import MAX_LENGTH, MIN_SUPPORT, Itemsets
from tillscope.session import materialise


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` items whose subsets of ``size - 1`` are all ``frequent(ids)``.

    Two frequent sets with the same first items make a candidate; its other subsets
    are looked up by an equi join.
    """
    head, last = F.slice("ids", 1, size - 2), F.element_at("ids", -1)
    left = frequent.select(head.alias("head"), last.alias("one"))
    right = frequent.select(head.alias("_head"), last.alias("two"))
    joined = left.join(right, (F.col("head") == F.col("_head")) & (F.col("one") < F.col("two")))
    made = joined.select(F.concat("head", F.array("one", "two")).alias("ids"))
    if size == 2:
        return made
    subsets = made.select(
        "ids", F.explode(F.transform("ids", lambda i: F.array_remove("ids", i))).alias("_subset")
    )
    known = frequent.select(F.col("ids").alias("_known"))
    return (
        subsets.join(known, F.col("_subset") == F.col("_known"), "left_semi")
        .groupBy("ids")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == size)
        .select("ids")
    )


def mine_levels(
    pairs: DataFrame, min_support: float = MIN_SUPPORT, max_length: int = MAX_LENGTH
) -> Itemsets:
    """Itemsets of ``max_length`` items at most in ``ceil(min_support * baskets)`` baskets.

    The rows of ``rules.mine_itemsets``, but the limit holds while mining: level k
    looks only at sets of k items all of whose subsets are frequent, and keeps for
    each basket the frequent sets that it holds (so a set is found in a basket by
    joining two of its subsets there). No set is broadcast or collected, each level
    is checkpointed, and counts are combined before the shuffle; a popular set is
    one row per basket. ``pairs`` are distinct ``(order_id, item)`` rows; null items are no
    items. An empty table gives no itemsets.
    """
    if max_length < 1 or not 0 < min_support <= 1:
        raise ValueError("max_length must be 1 or more, min_support above 0 and at most 1")
    pairs = materialise(pairs.select("order_id", "item"))
    n_baskets = count_baskets(pairs).first()[0]
    pairs = pairs.select(F.col("order_id").alias("_order"), F.col("item").alias("_item"))
    least = max(1, math.ceil(min_support * n_baskets - 1e-9))
    counted = (
        pairs.where("_item IS NOT NULL")
        .groupBy("_item")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= least)
    )
    names = materialise(row_index(counted, ["_item"], "_id"))
    found = [names.select(F.array("_id").alias("ids"), "count")]
    held = materialise(
        pairs.join(names.select(F.col("_item").alias("_name"), "_id"), F.col("_item") == F.col("_name"))
        .select("_order", F.array("_id").alias("ids"))
    )
    for size in range(2, max_length + 1):
        wanted = materialise(_candidates(found[-1].select("ids"), size))
        if wanted.isEmpty():
            break
        head, last = F.slice("ids", 1, size - 2), F.element_at("ids", -1)
        left = held.select("_order", head.alias("head"), last.alias("one"))
        right = held.select(
            F.col("_order").alias("_other"), head.alias("_head"), last.alias("two")
        )
        same = (F.col("_order") == F.col("_other")) & (F.col("head") == F.col("_head"))
        grown = left.join(right, same & (F.col("one") < F.col("two"))).select(
            "_order", F.concat("head", F.array("one", "two")).alias("ids")
        )
        sets = wanted.select(F.col("ids").alias("_ids"))
        held = materialise(grown.join(sets, F.col("ids") == F.col("_ids"), "left_semi"))
        level = materialise(
            held.groupBy("ids").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
        )
        if level.isEmpty():
            break
        found.append(level)
        kept = level.select(F.col("ids").alias("_ids"))
        held = held.join(kept, F.col("ids") == F.col("_ids"), "left_semi")
    every = reduce(DataFrame.unionByName, found)
    spelled = (
        every.withColumn("_set", F.col("ids"))
        .select("_set", "count", F.explode("ids").alias("_one"))
        .join(names.select("_id", "_item"), F.col("_one") == F.col("_id"))
        .groupBy("_set", "count")
        .agg(F.array_sort(F.collect_list("_item")).alias("items"))
    )
    return Itemsets(materialise(spelled.select("items", "count")), n_baskets, max_length)
