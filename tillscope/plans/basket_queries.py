"""Queries for itemsets, rules and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.operators import baskets, level_mining, margins, rules
from tillscope.operators.quantiles import exact_quantiles
from tillscope.plans.registry import query, rounded
from tillscope.plans.test_tables import item_margins, order_lines
from tillscope.plans.views import (
    GROUP_CONFIDENCE,
    GROUP_SUPPORT,
    ITEM_CONFIDENCE,
    ITEM_SUPPORT,
    PRUNE_CONFIDENCE,
    PRUNED,
    itemset_blocks,
    rule_blocks,
    sql,
)
from tillscope.session import materialise

_ITEM_LEVELS = 3
_GROUP_LEVELS = 6

_ITEM_SETS = itemset_blocks("items", rules.MIN_SUPPORT, rules.MAX_LENGTH)
_ITEM_RULES = rule_blocks("items", ITEM_SUPPORT, ITEM_CONFIDENCE, _ITEM_LEVELS)
_GROUP_RULES = rule_blocks("groups", GROUP_SUPPORT, GROUP_CONFIDENCE, _GROUP_LEVELS)
_PRUNED = {
    **rule_blocks("items", ITEM_SUPPORT, PRUNE_CONFIDENCE, _ITEM_LEVELS),
    "kept": PRUNED,
    "kept_items": "SELECT DISTINCT unnest(items) AS item FROM kept",
}
_PRICED = {
    **_PRUNED,
    "parts": "SELECT rule, unnest(items) AS item FROM kept",
    "totals": """
        SELECT p.rule, sum(m.margin) AS total_margin, count(*) - count(m.margin) AS unknown_items
        FROM parts p LEFT JOIN item_margin m ON m.item = p.item GROUP BY p.rule""",
    "report": """
        SELECT k.rule AS "Rule", round(k.support, 6) AS "Support",
               round(k.confidence, 3) AS "Confidence", round(k.lift, 2) AS "Lift",
               CAST(round(CAST(round(t.total_margin, 10) AS DECIMAL(28, 10)), 4) AS DOUBLE)
               AS "Total_Margin"
        FROM kept k JOIN totals t ON t.rule = k.rule WHERE t.unknown_items = 0""",
}


def _pairs(spark, root, item="product_title"):
    return baskets.order_items(order_lines(spark, root, ["order_id", item]), item)


def _mined(spark, root, item="product_title", support=ITEM_SUPPORT):
    lines = order_lines(spark, root, ["order_id", item])
    return rules.mine_baskets(baskets.collect_baskets(lines, item), support)


def _item_rules(spark, root, confidence=ITEM_CONFIDENCE):
    return rules.association_rules(_mined(spark, root), confidence)


def _group_rules(spark, root):
    mined = _mined(spark, root, "product_group_level_1", GROUP_SUPPORT)
    return rules.association_rules(mined, GROUP_CONFIDENCE)


def _kept(spark, root):
    # Read several times from here on, and small.
    return materialise(rules.prune_subsumed(_item_rules(spark, root, PRUNE_CONFIDENCE)))


def _margins(spark, root):
    return item_margins(spark, root)


def _flat(found):
    """Sides as text and measures rounded, for comparison."""
    return rounded(
        found.select(
            F.array_join("antecedent", ",").alias("antecedent"),
            F.array_join("consequent", ",").alias("consequent"),
            "support",
            "confidence",
            "coverage",
            "lift",
            "count",
        ),
        support=10,
        confidence=10,
        coverage=10,
        lift=8,
    )


_FLAT = (
    "SELECT array_to_string(antecedent, ',') AS antecedent, consequent, "
    "round(support, 10) AS support, round(confidence, 10) AS confidence, "
    "round(coverage, 10) AS coverage, round(lift, 8) AS lift, count FROM "
)


@query("rule_label", sql("items", "SELECT rule FROM rules", **_ITEM_RULES))
def rule_label(spark, root):
    return _item_rules(spark, root).select(rules.rule_label().alias("rule"))


@query(
    "array_flatten",
    sql("groups", "SELECT rule, unnest(items) AS item FROM rules", **_GROUP_RULES),
)
def array_flatten(spark, root):
    return margins.rule_pairs(_group_rules(spark, root))


@query(
    "agg_distinct_items",
    sql("items", "SELECT DISTINCT unnest(items) AS item FROM rules", **_ITEM_RULES),
)
def agg_distinct_items(spark, root):
    return rules.items_in_rules(_item_rules(spark, root))


@query(
    "mba_frequent_itemsets",
    sql("items", "SELECT array_to_string(items, ',') AS items, len(items) AS size, count "
        "FROM itemsets", **_ITEM_SETS),
)
def mba_frequent_itemsets(spark, root):
    """All sets at the support and the length limit of the reference."""
    mined = _mined(spark, root, support=rules.MIN_SUPPORT).table
    return mined.select(
        F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("size"), "count"
    )


@query(
    "mba_itemsets_bounded",
    sql("groups", "SELECT array_to_string(items, ',') AS items, len(items) AS size, count "
        "FROM itemsets", **itemset_blocks("groups", GROUP_SUPPORT, 3)),
)
def mba_itemsets_bounded(spark, root):
    """Sets of three items at most, mined with that limit."""
    mined = level_mining.mine_levels(_pairs(spark, root, "product_group_level_1"), GROUP_SUPPORT, 3)
    return mined.table.select(
        F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("size"), "count"
    )


@query("mba_rules", sql("items", _FLAT + "rules", **_ITEM_RULES))
def mba_rules(spark, root):
    return _flat(_item_rules(spark, root))


@query("mba_rules_groups", sql("groups", _FLAT + "rules", **_GROUP_RULES))
def mba_rules_groups(spark, root):
    """Rules between product groups: a few popular items, rules of length 2 to 4."""
    return _flat(_group_rules(spark, root))


@query(
    "mba_rule_summary",
    sql("groups", "SELECT len(items) AS length, count(*) AS rules FROM rules GROUP BY len(items)",
        **_GROUP_RULES),
)
def mba_rule_summary(spark, root):
    return rules.rule_length_summary(_group_rules(spark, root))


@query(
    "join_containment",
    sql("groups", "SELECT a.rule, b.rule AS inner_rule FROM rules a JOIN rules b "
        "ON list_has_all(a.items, b.items)", **_GROUP_RULES),
)
def join_containment(spark, root):
    return rules.contained_rules(materialise(_group_rules(spark, root)))


@query("mba_prune_subsumed", sql("items", _FLAT + "kept", **_PRUNED))
def mba_prune_subsumed(spark, root):
    return _flat(rules.prune_subsumed(materialise(_item_rules(spark, root, PRUNE_CONFIDENCE))))


@query(
    "mba_rank_by_lift",
    sql("items", "SELECT rule, round(lift, 8) AS lift, count FROM kept "
        "ORDER BY kept.lift DESC, rule LIMIT 21", **_PRUNED),
)
def mba_rank_by_lift(spark, root):
    ranked = rules.rank_by_lift(_kept(spark, root), 21)
    return rounded(ranked.select("rule", "lift", "count"), lift=8)


@query(
    "mba_item_margin",
    sql("items item_margin", "SELECT item, round(margin, 8) AS margin FROM item_margin "
        "JOIN kept_items USING (item)", **_PRUNED),
)
def mba_item_margin(spark, root):
    found = margins.item_margins_for(_kept(spark, root), item_margins(spark, root))
    return rounded(found, margin=8)


@query(
    "agg_quantiles",
    sql("items item_margin", "SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS p, "
        "round(unnest(q), 8) AS margin FROM (SELECT quantile_cont(m.margin, "
        "[0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM item_margin m JOIN kept_items k "
        "ON k.item = m.item)", **_PRUNED),
)
def agg_quantiles(spark, root):
    levels = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = margins.item_margins_for(_kept(spark, root), item_margins(spark, root))
    quantiles = exact_quantiles(found, ["margin"], levels)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in levels]).alias("p"), F.col("quantiles"))
    return rounded(
        quantiles.select(F.inline(pairs)).toDF("p", "margin"),
        margin=8,
    )


@query(
    "join_lookup",
    sql("items item_margin", "SELECT p.rule, p.item, round(m.margin, 8) AS margin FROM parts p "
        "JOIN item_margin m ON m.item = p.item", **_PRICED),
)
def join_lookup(spark, root):
    pairs = margins.rule_pairs(_kept(spark, root))
    return rounded(pairs.join(_margins(spark, root), "item"), margin=8)


@query(
    "mba_rule_margin",
    sql("items item_margin", "SELECT rule, round(total_margin, 8) AS total_margin FROM totals "
        "WHERE unknown_items = 0", **_PRICED),
)
def mba_rule_margin(spark, root):
    pairs = margins.rule_pairs(_kept(spark, root))
    return rounded(margins.margin_sums(pairs, _margins(spark, root), ["rule"]), total_margin=8)


@query(
    "mba_basket_margin",
    sql("items item_margin", "SELECT i.order_id, round(sum(m.margin), 8) AS total_margin FROM "
        "items i LEFT JOIN item_margin m ON m.item = i.item GROUP BY i.order_id "
        "HAVING count(*) = count(m.margin)"),
)
def mba_basket_margin(spark, root):
    sums = margins.margin_sums(_pairs(spark, root), _margins(spark, root), ["order_id"])
    return rounded(sums, total_margin=8)


@query(
    "mba_margin_missing",
    sql("items item_margin some_margins", "SELECT rule, unknown_items FROM totals "
        "WHERE unknown_items > 0",
        **{**_PRICED, "totals": _PRICED["totals"].replace("item_margin", "some_margins")}),
)
def mba_margin_missing(spark, root):
    """Against a margin table that lacks some titles, which is what it reports."""
    pairs = margins.rule_pairs(_kept(spark, root))
    known = _margins(spark, root).where(~F.col("item").startswith("blue "))
    return margins.margins_missing(pairs, known, ["rule"])


@query(
    "mba_rule_report",
    sql("items item_margin", 'SELECT * FROM report ORDER BY "Total_Margin" DESC, "Rule"', **_PRICED),
)
def mba_rule_report(spark, root):
    report = margins.rule_report(_kept(spark, root), _margins(spark, root))
    return margins.rank_by_margin(report)


@query(
    "mba_business_score",
    sql("items item_margin", 'SELECT "Rule", "Lift", "Total_Margin", '
        'round("Lift" * "Total_Margin", 6) AS "Business_Score" FROM report '
        'ORDER BY "Business_Score" DESC, "Rule" LIMIT 10', **_PRICED),
)
def mba_business_score(spark, root):
    report = margins.rule_report(_kept(spark, root), _margins(spark, root))
    return rounded(margins.business_score(report), Business_Score=6)
