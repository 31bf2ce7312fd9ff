"""Frequent itemsets and association rules."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.baskets import baskets_of, count_pairs
from tillscope.session import materialise

# Default thresholds of the rule search.
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.4
MAX_LENGTH = 10

# Sets of one level that are broadcast; a longer level is joined by a shuffle.
_BROADCAST_SETS = 100_000
# Frequent items that are written into an expression; more of them are joined.
_LISTED_ITEMS = 10_000


@dataclass(frozen=True)
class Itemsets:
    """Frequent itemsets ``(items, count)`` and the number of baskets."""

    table: DataFrame
    n_baskets: int
    max_length: int


def _heads(held: DataFrame, *head: str, least: int = 1) -> DataFrame:
    """Each item of ``rest`` put behind the head, with the items that come after it, ``least`` of them or more."""
    after = F.slice("rest", F.col("_at") + 2, F.size("rest"))
    return (
        held.select(*head, "weight", "rest", F.posexplode("rest").alias("_at", "_item"))
        .where(F.col("_at") + least < F.size("rest"))
        .select(F.concat(*head, F.array("_item")).alias("head"), after.alias("rest"), "weight")
    )


def _grow(held: DataFrame, level: DataFrame) -> DataFrame:
    """Held rows of the sets in ``level``, with the later items that may extend them.

    An item may extend a set if the set without its last item is frequent with it. The
    level is broadcast while it is small; otherwise the join is left to Spark. A row
    with one later item makes no set that another could extend.
    """
    allowed = level.groupBy("head").agg(F.collect_list("item").alias("_allowed"))
    if level.count() <= _BROADCAST_SETS:
        allowed = F.broadcast(allowed)
    kept = F.array_intersect("rest", "_allowed").alias("rest")
    longer = held.where(F.size("rest") > 1)
    return _heads(longer.join(allowed, "head").select("head", "weight", kept), "head")


def _next_level(held: DataFrame, least: int) -> DataFrame:
    """Sets ``(head, item, count)`` that a held head makes with one of its later items."""
    return (
        held.select("head", "weight", F.explode("rest").alias("item"))
        .groupBy("head", "item")
        .agg(F.sum("weight").alias("count"))
        .where(F.col("count") >= least)
    )


def _frequent_only(baskets: DataFrame, ones: DataFrame, least: int) -> DataFrame:
    """Baskets reduced to the items of ``ones`` that reach the minimum count.

    A short list of items is looked up in a set inside the arrays, which moves no row.
    A longer one, which only a low support allows, is joined to the items of each basket.
    """
    frequent = ones.where(F.col("count") >= least).select("item")
    kept = frequent.count()
    if kept == ones.count():
        return baskets
    if kept <= _LISTED_ITEMS:
        names = [row["item"] for row in frequent.collect()]
        return baskets.select(F.filter("items", lambda item: item.isin(names)).alias("items"))
    numbered = baskets.select(F.monotonically_increasing_id().alias("_basket"), "items")
    return (
        numbered.select("_basket", F.explode("items").alias("item"))
        .join(frequent, "item")
        .groupBy("_basket")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("items")
    )


def mine_itemsets(
    pairs: DataFrame, min_support: float = MIN_SUPPORT, max_length: int = MAX_LENGTH
) -> Itemsets:
    """Itemsets in at least ``ceil(min_support * baskets)`` baskets, from ``(order_id, item)`` pairs.

    ``pairs`` are distinct; a repeated one raises. Lines that are not distinct yet cost
    fewer shuffles as ``mine_baskets(collect_baskets(lines))``.
    """
    return _mine(baskets_of(pairs), min_support, max_length, may_repeat=True)


def mine_baskets(
    baskets: DataFrame, min_support: float = MIN_SUPPORT, max_length: int = MAX_LENGTH
) -> Itemsets:
    """The same from baskets whose ``items`` are distinct and sorted, as ``collect_baskets`` gives them."""
    return _mine(baskets, min_support, max_length)


def _mine(baskets: DataFrame, min_support: float, max_length: int, may_repeat: bool = False) -> Itemsets:
    """Itemsets of baskets.

    The baskets are written once, counted, and reduced to frequent items; emptied
    baskets still count. Grows sets by their prefix: a row holds a frequent set and
    those later items of its basket that may extend it, and the extensions are
    counted where they arise, before any shuffle. Pairs are counted straight from
    the baskets. From then on equal rows are merged into one with a weight, so that
    items which often occur together cost one row per set and not one per basket.
    The length limit holds while mining.
    """
    if not 0 <= min_support <= 1:
        raise ValueError("min_support must be from 0 to 1")
    baskets = materialise(baskets.select("items"))
    n_baskets = baskets.count()
    least = math.ceil(min_support * n_baskets)
    ones = materialise(
        baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))
    )
    found = [ones.where(F.col("count") >= least).select(F.array("item").alias("items"), "count")]
    baskets = _frequent_only(baskets, ones, least)
    if may_repeat:
        items = F.col("items")
        unique = F.when(F.size(F.array_distinct(items)) == F.size(items), items).otherwise(
            F.raise_error(F.lit("an item comes twice in a basket"))
        )
        baskets = materialise(baskets.select(unique.alias("items")))
    # Every pair of frequent items is a candidate, so pairs need no held rows.
    twos = count_pairs(baskets).where(F.col("count") >= least)
    level = twos.select(F.array("item_a").alias("head"), F.col("item_b").alias("item"), "count")
    # A row that is grown from here on needs two later items.
    whole = baskets.select(F.col("items").alias("rest"), F.lit(1).cast("long").alias("weight"))
    held = _heads(whole, least=2)
    for size in range(2, max_length + 1):
        level = materialise(level)
        if level.isEmpty():
            break
        found.append(level.select(F.concat("head", F.array("item")).alias("items"), "count"))
        if size < max_length:
            held = _grow(held, level).groupBy("head", "rest").agg(F.sum("weight").alias("weight"))
            held = materialise(held)
            level = _next_level(held, least)
    if max_length < 1:
        found = [found[0].limit(0)]
    return Itemsets(materialise(reduce(DataFrame.unionByName, found)), n_baskets, max_length)


def association_rules(itemsets: Itemsets, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules with one item on the right side and their quality measures.

    Both lookups (antecedent and consequent count) are equi joins on itemsets.
    """
    table, n = itemsets.table, F.lit(float(itemsets.n_baskets))
    split = table.where(F.size("items") > 1).select(
        "count", "items", F.explode("items").alias("_item")
    )
    split = split.select(
        "count",
        F.array_remove("items", F.col("_item")).alias("antecedent"),
        F.array("_item").alias("consequent"),
    )
    antecedents = table.select(
        F.col("items").alias("antecedent"), F.col("count").alias("_antecedent_count")
    )
    consequents = table.where(F.size("items") == 1).select(
        F.col("items").alias("consequent"), F.col("count").alias("_consequent_count")
    )
    return (
        split.join(antecedents, "antecedent")
        .withColumn("confidence", F.col("count") / F.col("_antecedent_count"))
        .where(F.col("confidence") >= min_confidence)
        .join(consequents, "consequent")
        .select(
            "antecedent",
            "consequent",
            (F.col("count") / n).alias("support"),
            "confidence",
            (F.col("_antecedent_count") / n).alias("coverage"),
            (F.col("confidence") / (F.col("_consequent_count") / n)).alias("lift"),
            "count",
        )
    )


def rule_items() -> Column:
    """All items of a rule, both sides, sorted."""
    return F.array_sort(F.array_union("antecedent", "consequent"))


def rule_label() -> Column:
    """A rule as ``{a,b} => {c}``."""
    return F.concat(
        F.lit("{"),
        F.array_join("antecedent", ","),
        F.lit("} => {"),
        F.array_join("consequent", ","),
        F.lit("}"),
    )


def rule_length_summary(rules: DataFrame) -> DataFrame:
    """Number of rules by length (items on both sides)."""
    return rules.groupBy(F.size(rule_items()).cast("long").alias("length")).agg(
        F.count(F.lit(1)).alias("rules")
    )


def items_in_rules(rules: DataFrame) -> DataFrame:
    """The distinct items that occur in any rule."""
    return rules.select(F.explode(rule_items()).alias("item")).distinct()


def contained_itemsets(rules: DataFrame) -> DataFrame:
    """Pairs ``(items, inner, inner_rules)``: ``inner`` is a subset of ``items``.

    Both are itemsets of rules; an itemset contains itself. ``inner_rules`` counts
    the rules that share the inner itemset. An itemset is compared with those
    inner sets whose rarest item it holds, so a popular item makes few pairs.
    """
    sets = rules.groupBy(rule_items().alias("items")).agg(F.count(F.lit(1)).alias("inner_rules"))
    inner = sets.select(F.col("items").alias("inner"), "inner_rules")
    frequency = (
        sets.select(F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    anchored = (
        inner.select("inner", "inner_rules", F.explode("inner").alias("item"))
        .join(frequency, "item")
        .groupBy("inner", "inner_rules")
        .agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    )
    return (
        sets.select("items", F.explode("items").alias("item"))
        .join(anchored, "item")
        .where(F.size(F.array_except("inner", "items")) == 0)
        .select("items", "inner", "inner_rules")
    )


def contained_rules(rules: DataFrame) -> DataFrame:
    """Pairs of rule labels ``(rule, inner_rule)``, by itemset containment."""
    labelled = rules.select(rule_items().alias("items"), rule_label().alias("rule"))
    inner = labelled.select(F.col("items").alias("inner"), F.col("rule").alias("inner_rule"))
    return (
        contained_itemsets(rules)
        .join(labelled, "items")
        .join(inner, "inner")
        .select("rule", "inner_rule")
    )


def prune_subsumed(rules: DataFrame) -> DataFrame:
    """Keep rules whose itemset contains no other rule's itemset.

    Equal itemsets contain each other, so of ``a => b`` and ``b => a`` neither
    is kept. Confidence and lift play no part.
    """
    lonely = (
        contained_itemsets(rules)
        .groupBy("items")
        .agg(F.sum("inner_rules").alias("_within"))
        .where("_within = 1")
        .select(F.col("items").alias("_items"))
    )
    return (
        rules.withColumn("_all", rule_items())
        .join(lonely, F.col("_all") == F.col("_items"), "left_semi")
        .drop("_all")
    )


def rank_by_lift(rules: DataFrame, n: int | None = None) -> DataFrame:
    """Rules by falling lift, labels breaking ties; the first ``n`` if given."""
    ranked = rules.withColumn("rule", rule_label()).orderBy(F.desc("lift"), "rule")
    return ranked.limit(n) if n is not None else ranked
