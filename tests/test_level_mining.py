"""Level-wise mining against counting all sets, and against the miner without a limit."""

import itertools
import math
import random
from collections import Counter

import pytest

from tillscope.operators import level_mining, rules


def _pairs(spark, baskets):
    rows = [(str(n), item) for n, basket in enumerate(baskets) for item in sorted(set(basket))]
    return spark.createDataFrame(rows, "order_id string, item string")


def _plain(baskets, support, length):
    baskets = [sorted(set(b)) for b in baskets if b]
    least = max(1, math.ceil(support * len(baskets) - 1e-9))
    counts = Counter(
        c for b in baskets for k in range(1, length + 1) for c in itertools.combinations(b, k)
    )
    return {c: n for c, n in counts.items() if n >= least}


def _found(mined):
    return {tuple(r["items"]): r["count"] for r in mined.table.collect()}


@pytest.mark.parametrize("length", (1, 2, 3, 5))
def test_all_sets_in_reach_are_found(spark, length):
    rng = random.Random(length)
    names = [f"item {k}, {k}" for k in range(12)]
    weights = [1 / (k + 1) for k in range(12)]
    baskets = [rng.choices(names, weights, k=rng.randint(1, 9)) for _ in range(300)]
    mined = level_mining.mine_levels(_pairs(spark, baskets), 0.03, length)
    assert _found(mined) == _plain(baskets, 0.03, length)
    assert (mined.n_baskets, mined.max_length) == (300, length)


def test_rows_are_those_of_the_unlimited_miner(spark):
    rng = random.Random(9)
    baskets = [rng.sample("abcdefgh", rng.randint(1, 6)) for _ in range(200)]
    pairs = _pairs(spark, baskets)
    assert _found(level_mining.mine_levels(pairs, 0.02, 4)) == _found(rules.mine_itemsets(pairs, 0.02, 4))


def test_a_family_of_long_baskets_stops_at_the_limit(spark):
    """Forty items together in every basket hold 2^40 sets; 820 have two items at most."""
    baskets = [[f"i{k:02}" for k in range(40)]] * 30
    found = _found(level_mining.mine_levels(_pairs(spark, baskets), 0.5, 2))
    assert len(found) == 40 + 780 and set(found.values()) == {30}


def test_rules_follow_from_the_levels(spark):
    baskets = [["a", "b"]] * 6 + [["a"]] * 2 + [["c"]] * 2
    mined = level_mining.mine_levels(_pairs(spark, baskets), 0.2, 2)
    found = {(r["antecedent"][0], r["consequent"][0]): r for r in rules.association_rules(mined, 0.5).collect()}
    assert found["a", "b"]["confidence"] == pytest.approx(0.75)
    assert found["b", "a"]["lift"] == pytest.approx(1 / 0.8)


def test_nulls_empty_tables_and_bad_limits(spark):
    pairs = spark.createDataFrame([("1", "a"), ("1", None), ("2", "a")], "order_id string, item string")
    assert _found(level_mining.mine_levels(pairs, 0.5, 3)) == {("a",): 2}
    assert _found(level_mining.mine_levels(pairs.limit(0), 0.5, 3)) == {}
    with pytest.raises(ValueError):
        level_mining.mine_levels(pairs, 0.5, 0)
