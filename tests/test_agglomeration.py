"""Clustering features and their merges against plain agglomeration of all rows."""

import itertools

import numpy as np
import pytest

from tillscope.operators import agglomeration
from tillscope.operators.clustering import FEATURES

_SCHEMA = "customer_id long, recency double, frequency double, monetary double"


def _rows(seed, n, spread=50.0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(0, 1000, (4, 3))
    return [
        (i, *(float(v) for v in centers[i % 4] + rng.normal(0, spread, 3))) for i in range(n)
    ]


def _plain(points, power):
    """Lance-Williams over single points, from a dictionary of all pairs."""
    sizes = {i: 1 for i in range(1, len(points) + 1)}
    gap = {
        frozenset(p): float(np.sum((points[p[0] - 1] - points[p[1] - 1]) ** 2)) ** (power / 2)
        for p in itertools.combinations(sizes, 2)
    }
    heights, made = [], len(points)
    while len(sizes) > 1:
        pair = min(gap, key=lambda p: (gap[p], sorted(p)))
        i, j = sorted(pair)
        made += 1
        heights.append(((i, j), gap[pair]))
        for k in set(sizes) - pair:
            total = sizes[i] + sizes[j] + sizes[k]
            gap[frozenset((made, k))] = (
                (sizes[i] + sizes[k]) * gap[frozenset((i, k))]
                + (sizes[j] + sizes[k]) * gap[frozenset((j, k))]
                - sizes[k] * gap[pair]
            ) / total
        sizes[made] = sizes.pop(i) + sizes.pop(j)
        gap = {p: d for p, d in gap.items() if i not in p and j not in p}
    return heights


@pytest.mark.parametrize("power", (1, 2))
def test_every_row_its_own_feature_is_the_plain_method(spark, power):
    rows = _rows(1, 60)
    base = spark.createDataFrame(rows, _SCHEMA).repartition(5)
    found = agglomeration.clustering_features(base, 100).orderBy("feature").collect()
    assert [r["n"] for r in found] == [1] * 60
    points = np.array([r["mean"] for r in found])
    assert np.allclose(sorted(map(tuple, points)), sorted(r[1:] for r in rows))
    features = spark.createDataFrame(found)
    tree = agglomeration.merge_tree(features, power).orderBy("step").collect()
    want = _plain(points, power)
    assert [(r["left"], r["right"]) for r in tree] == [pair for pair, _ in want]
    assert np.allclose([r["height"] for r in tree], [h for _, h in want])
    heights = [r["height"] for r in tree]
    assert heights == sorted(heights) and [r["clusters"] for r in tree] == list(range(59, 0, -1))
    assert tree[-1]["customers"] == 60


def test_squared_heights_are_twice_the_growth_of_the_scatter():
    points = np.array([r[1:] for r in _rows(2, 40)])
    members = {i: [i - 1] for i in range(1, 41)}

    def scatter(own):
        return ((points[own] - points[own].mean(axis=0)) ** 2).sum()

    merges = agglomeration.merge_features(np.ones(40), points, 2)
    for step, (left, right, height, rows) in enumerate(merges, start=1):
        a, b = members.pop(left), members.pop(right)
        growth = scatter(a + b) - scatter(a) - scatter(b)
        least = min(
            scatter(x + y) - scatter(x) - scatter(y)
            for x, y in itertools.combinations([a, b, *members.values()], 2)
        )
        assert height == pytest.approx(2 * growth) and growth == pytest.approx(least)
        members[40 + step] = a + b
        assert rows == len(a + b)


@pytest.mark.parametrize("power", (1, 2))
def test_a_weight_stands_for_that_many_equal_points(power):
    points = np.array([r[1:] for r in _rows(3, 12)])
    weights = np.array([1, 5, 2, 1, 1, 3, 1, 4, 1, 1, 2, 1])
    copies = np.repeat(points, weights, axis=0)
    single = [h for *_, h, _ in agglomeration.merge_features(np.ones(len(copies)), copies, power)]
    weighted = [h for *_, h, _ in agglomeration.merge_features(weights, points, power)]
    assert np.allclose([h for h in single if h > 1e-9], weighted)


@pytest.mark.parametrize("bound", (1, 7, 64, 500))
def test_features_are_bounded_and_hold_every_row(spark, bound):
    rows = _rows(4, 3000, 80.0)
    base = spark.createDataFrame(rows, _SCHEMA)
    found = agglomeration.clustering_features(base, bound).collect()
    assert 1 <= len(found) <= bound and sum(r["n"] for r in found) == 3000
    points = np.array([r[1:] for r in rows])
    sums = sum(r["n"] * np.array(r["mean"]) for r in found)
    assert np.allclose(sums, points.sum(axis=0))
    assert agglomeration.clustering_features(base.repartition(3), bound).count() == len(found)


def test_rows_get_the_cluster_of_their_feature(spark):
    rows = _rows(5, 2000, 15.0)
    base = spark.createDataFrame([(*r, "x") for r in rows], _SCHEMA + ", level string")
    labelled = agglomeration.ward_clusters(base, 4, 64)
    assert labelled.columns == [*base.columns, "cluster"]
    groups = {}
    for r in labelled.collect():
        groups.setdefault(r["cluster"], set()).add(r["customer_id"] % 4)
    assert sorted(groups) == [1, 2, 3, 4] and all(len(g) == 1 for g in groups.values())


def test_equal_rows_empty_tables_and_bad_values(spark):
    equal = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(5)], _SCHEMA)
    (only,) = agglomeration.clustering_features(equal).collect()
    assert (only["n"], only["mean"]) == (5, [1.0, 2.0, 3.0])
    assert {r["cluster"] for r in agglomeration.ward_clusters(equal).collect()} == {1}
    empty = equal.limit(0)
    assert agglomeration.clustering_features(empty).isEmpty()
    assert agglomeration.ward_clusters(empty).isEmpty()
    with pytest.raises(ValueError):
        agglomeration.clustering_features(spark.createDataFrame([(1, None, 2.0, 3.0)], _SCHEMA))


def test_gain_compares_a_merge_with_all_before(spark):
    tree = spark.createDataFrame(
        [(1, 1, 2, 2.0, 2, 3), (2, 3, 4, 3.0, 2, 2), (3, 5, 6, 10.0, 4, 1)], agglomeration._TREE
    )
    found = [tuple(r) for r in agglomeration.merge_gain(tree, 2).orderBy("step").collect()]
    assert found == [(2, 2, 3.0, 1.5), (3, 1, 10.0, 2.0)]


def test_columns_are_the_customer_features():
    assert FEATURES == ("recency", "frequency", "monetary")
