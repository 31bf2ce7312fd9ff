"""Baskets, rules and margins."""

import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import check, connect
from pyspark.sql import functions as F

from tillscope.operators import baskets, margins, rules
from tillscope.plans.catalogue import QUERIES

RULE = "antecedent array<string>, consequent array<string>"


def _pairs(spark, found):
    rows = [(str(i), item) for i, basket in enumerate(found) for item in basket]
    return spark.createDataFrame(rows, "order_id string, item string")


def _rules(spark, *sides):
    rows = [(list(a), [c]) for a, c in sides]
    return spark.createDataFrame(rows, RULE)


def _labels(df):
    return sorted(r[0] for r in df.select(rules.rule_label()).collect())


def test_minimum_count_is_rounded_up(spark):
    found = rules.mine_itemsets(_pairs(spark, ["ab", "a", "bc", "ab", "c"]), 0.5)
    assert {tuple(r["items"]): r["count"] for r in found.table.collect()} == {("a",): 3, ("b",): 3}
    assert found.n_baskets == 5


def test_basket_has_distinct_unsplit_items(spark):
    lines = spark.createDataFrame(
        [("1", "x12,5cm"), ("2", "b"), ("2", "a"), ("2", "b")], "order_id string, product_title string"
    )
    found = {r["order_id"]: r["items"] for r in baskets.collect_baskets(lines).collect()}
    assert found == {"1": ["x12,5cm"], "2": ["a", "b"]}
    text = {r["order_id"]: r["items"] for r in baskets.collapse_items(lines).collect()}
    assert text == {"1": "x12,5cm", "2": "a,b,b"}


def test_mining_and_rules_equal_brute_force(spark):
    rng = random.Random(11)
    weights = [9, 7, 5, 3, 2, 1, 1]
    found = [set(rng.choices("abcdefg", weights, k=rng.randint(1, 6))) for _ in range(400)]
    n, minimum = len(found), -(-400 * 5 // 100)
    counts = {}
    for size in range(1, 8):
        for items in itertools.combinations("abcdefg", size):
            count = sum(set(items) <= basket for basket in found)
            if count >= minimum:
                counts[items] = count
    mined = rules.mine_itemsets(_pairs(spark, found), 0.05)
    assert {tuple(r["items"]): r["count"] for r in mined.table.collect()} == counts
    want = {}
    for items, count in counts.items():
        for item in items if len(items) > 1 else ():
            rest = tuple(i for i in items if i != item)
            confidence = count / counts[rest]
            if confidence >= 0.4:
                want[rest, item] = (count / n, confidence, confidence / (counts[(item,)] / n))
    got = {
        (tuple(r["antecedent"]), r["consequent"][0]): (r["support"], r["confidence"], r["lift"])
        for r in rules.association_rules(mined, 0.4).collect()
    }
    assert got.keys() == want.keys()
    for key, measures in want.items():
        assert got[key] == pytest.approx(measures)
    pairs = {(r[0], r[1]): r[2] for r in baskets.cooccurring_pairs(_pairs(spark, found), 0.05).collect()}
    assert pairs == {k: v for k, v in counts.items() if len(k) == 2}


def test_longest_itemset_is_limited_after_mining(spark):
    mined = rules.mine_itemsets(_pairs(spark, ["abc"] * 3), 0.5, max_length=2)
    assert max(len(r["items"]) for r in mined.table.collect()) == 2


def test_pruning_drops_both_directions(spark):
    kept = rules.prune_subsumed(_rules(spark, ("a", "b"), ("b", "a"), ("c", "d")))
    assert _labels(kept) == ["{c} => {d}"]


def test_pruning_drops_supersets(spark):
    kept = rules.prune_subsumed(_rules(spark, ("a", "b"), ("ac", "b"), ("d", "e")))
    assert _labels(kept) == ["{a} => {b}", "{d} => {e}"]


def test_pruning_equals_brute_force(spark):
    rng = random.Random(5)
    sides = set()
    while len(sides) < 60:
        items = rng.sample("abcdefghij", rng.randint(2, 5))
        sides.add((tuple(sorted(items[1:])), items[0]))
    sides = sorted(sides)
    sets = [set(a) | {c} for a, c in sides]
    df = _rules(spark, *sides)
    want = sorted(
        f"{{{','.join(a)}}} => {{{c}}}"
        for (a, c), own in zip(sides, sets, strict=True)
        if sum(other <= own for other in sets) == 1
    )
    assert _labels(rules.prune_subsumed(df)) == want
    assert rules.contained_rules(df).count() == sum(b <= a for a in sets for b in sets)


def test_margins_leave_out_unknown_items(spark):
    found = margins.rule_pairs(_rules(spark, ("a", "b"), ("a", "z")))
    prices = spark.createDataFrame([("a", 0.3), ("b", -0.1)], "item string, margin double")
    sums = margins.margin_sums(found, prices, ["rule"]).collect()
    assert [(r["rule"], round(r["total_margin"], 9)) for r in sums] == [("{a} => {b}", 0.2)]
    missing = margins.margins_missing(found, prices, ["rule"]).collect()
    assert [(r["rule"], r["unknown_items"]) for r in missing] == [("{a} => {z}", 1)]


def test_score_uses_rounded_values(spark):
    found = _rules(spark, ("a", "b")).select(
        "*",
        F.lit(0.0005559).alias("support"),
        F.lit(0.57142).alias("confidence"),
        F.lit(380.1204).alias("lift"),
    )
    prices = spark.createDataFrame([("a", 0.8834036), ("b", 0.5296409)], "item string, margin double")
    report = margins.rule_report(found, prices)
    row = report.first()
    assert (row["Support"], row["Confidence"], row["Lift"], row["Total_Margin"]) == (
        0.000556,
        0.571,
        380.12,
        1.413,
    )
    assert round(margins.business_score(report).first()["Business_Score"], 4) == 537.1096


def test_summary_counts(spark):
    found = {
        r["metric"]: r["value"]
        for r in baskets.basket_summary(_pairs(spark, ["ab", "a", "abc", "c"]), top=1).collect()
    }
    assert found["baskets"] == 4 and found["items"] == 3
    assert found["density"] == pytest.approx(7 / 12)
    assert found["item=a"] == 3 and found["size=1"] == 2
    assert found["size_median"] == 1.5


def test_length_limit_holds_while_mining(spark):
    """All sets of these items would be 2^40 - 1."""
    items = [f"i{k:02d}" for k in range(40)]
    mined = rules.mine_itemsets(_pairs(spark, [items, items, items[:1]]), 0.5, max_length=2)
    counts = {tuple(r["items"]): r["count"] for r in mined.table.collect()}
    assert len(counts) == 40 + 780
    assert counts["i00",] == 3 and counts["i00", "i01"] == 2


def test_mining_merges_baskets_and_refuses_repeats(spark):
    mined = rules.mine_itemsets(_pairs(spark, ["abcdef"] * 30 + ["abcxyz"[k:] for k in range(6)]), 0.8)
    counts = {tuple(r["items"]): r["count"] for r in mined.table.collect()}
    want = [c for size in range(1, 7) for c in itertools.combinations("abcdef", size)]
    assert sorted(counts) == sorted(want) and counts["a", "b", "c"] == 31 and mined.n_baskets == 36
    with pytest.raises(Exception, match="comes twice"):
        rules.mine_itemsets(_pairs(spark, ["aa"]), 0.5)


@pytest.mark.parametrize("listed", [10_000, 0])
def test_mining_baskets_equals_mining_pairs(spark, monkeypatch, listed):
    """Rare items, repeated and untitled lines, by a listed and by a joined lookup of frequent items."""
    monkeypatch.setattr(rules, "_LISTED_ITEMS", listed)
    rng = random.Random(5)
    rows = [(str(k), i) for k in range(200) for i in rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=6)]
    rows += [(str(k), f"rare{k}") for k in range(200)] + [("200", None), (None, "a"), (None, "b"), ("201", "")]
    lines = spark.createDataFrame(rows, "order_id string, product_title string")
    mined = [
        rules.mine_itemsets(baskets.order_items(lines), 0.1),
        rules.mine_baskets(baskets.collect_baskets(lines), 0.1),
    ]
    counts = [{tuple(r["items"]): r["count"] for r in m.table.collect()} for m in mined]
    assert counts[0] == counts[1] and max(map(len, counts[0])) >= 3
    assert [m.n_baskets for m in mined] == [202, 202]
    held = [{i for o, i in rows if o == str(k)} for k in range(200)] + [{"a", "b"}, {""}]
    for size in (1, 2, 3):
        want = {s for s in itertools.combinations("abcdefgh", size) if sum(set(s) <= h for h in held) >= 21}
        assert {s for s in counts[1] if len(s) == size} == want


def test_rows_too_short_to_grow_are_not_made(spark):
    """A head that is grown needs two later items, one for the next set and one that may extend it."""
    held = spark.createDataFrame([(list("abcd"), 1), (list("xy"), 1)], "rest array<string>, weight long")
    found = {("".join(r["head"]), "".join(r["rest"])) for r in rules._heads(held, least=2).collect()}
    assert found == {("a", "bcd"), ("b", "cd")}
    level = spark.createDataFrame([(["a"], "b"), (["a"], "d"), (["b"], "c")], "head array<string>, item string")
    grown = rules._grow(rules._heads(held, least=2), level).collect()
    assert [("".join(r["head"]), "".join(r["rest"])) for r in grown] == [("ab", "d")]


def _star(root, found):
    """Baskets as the tables that order lines are made of."""
    names = sorted({item for basket in found for item in basket})
    lines = [(order, names.index(item)) for order, basket in enumerate(found) for item in basket]
    orders, parts = range(len(found)), range(len(names))
    tables = {
        "customer": {"c_custkey": [0], "c_nationkey": [0]},
        "orders": {"o_orderkey": orders, "o_custkey": [0] * len(found), "o_orderdate": ["1999-01-01"] * len(found)},
        "part": {"p_partkey": parts, "p_name": names, "p_type": names, "p_brand": names},
        "lineitem": {
            "l_orderkey": [order for order, _ in lines],
            "l_partkey": [part for _, part in lines],
            "l_extendedprice": [1.0] * len(lines),
            "l_discount": [0.0] * len(lines),
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table({k: list(v) for k, v in columns.items()}), f"{root}/{name}.parquet")


def test_query_mines_at_the_support_and_length_of_the_reference(spark, tmp_path):
    """Of 2,400 orders two make a frequent set, of ten items at most."""
    found = ["abcdefghijk"] * 2 + ["xyz"] * 2 + ["xyq"] + ["m"] * 2395
    _star(tmp_path, found)
    rows = QUERIES["mba_frequent_itemsets"](spark, str(tmp_path)).collect()
    counts = {tuple(r["items"].split(",")): r["count"] for r in rows}
    want = dict.fromkeys((s for k in range(1, 11) for s in itertools.combinations("abcdefghijk", k)), 2)
    want |= {("x",): 3, ("y",): 3, ("z",): 2, ("x", "y"): 3, ("x", "z"): 2, ("y", "z"): 2, ("x", "y", "z"): 2}
    assert counts == want | {("m",): 2395}
    good, note = check(spark, connect(str(tmp_path)), str(tmp_path), "mba_frequent_itemsets")
    assert good, note
