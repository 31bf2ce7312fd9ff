"""Clusters on three well separated groups."""

import numpy as np
import pytest

from tillscope.operators import clustering

CENTERS = {"a": (10.0, 2.0, 100.0), "b": (200.0, 8.0, 900.0), "c": (90.0, 20.0, 3000.0)}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    return [
        (f"{name}{i}", *(float(v) for v in np.array(center) + rng.normal(0, 1, 3)))
        for name, center in CENTERS.items()
        for i in range(40)
    ]


@pytest.fixture(scope="module")
def base(spark, points):
    return spark.createDataFrame(
        points, "customer_id string, recency double, frequency double, monetary double"
    )


def _groups(labelled):
    found = {}
    for row in labelled.collect():
        found.setdefault(row["cluster"], set()).add(row["customer_id"][0])
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("method", ["hierarchical_clusters", "flat_clusters"])
def test_groups_are_found(base, method):
    assert _groups(getattr(clustering, method)(base, k=3)) == [["a"], ["b"], ["c"]]


def test_fixed_lloyd_rounds_find_groups(base):
    labelled = clustering.lloyd_clusters(base, [0.1, 0.5, 0.9])
    assert _groups(labelled) == [["a"], ["b"], ["c"]]
    assert {r["customers"] for r in clustering.cluster_sizes(labelled).collect()} == {40}


def test_anova_equals_numpy(base, points):
    labelled = clustering.lloyd_clusters(base, [0.1, 0.5, 0.9])
    rows = {r["variable"]: r for r in clustering.anova(labelled).collect()}
    for i, name in enumerate(clustering.FEATURES, start=1):
        groups = [np.array([p[i] for p in points if p[0][0] == g]) for g in CENTERS]
        grand = np.mean(np.concatenate(groups))
        between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        row = rows[name]
        assert (row["df_between"], row["df_within"]) == (2, 117)
        assert row["ss_between"] == pytest.approx(between)
        assert row["f_value"] == pytest.approx((between / 2) / (within / 117))


def test_outliers_are_removed(base, spark):
    far = spark.createDataFrame([("far", 1e4, 1e4, 1e6)], base.schema)
    widened = base.unionByName(far)
    assert clustering.top_outliers(widened, 1).first()["customer_id"] == "far"
    assert clustering.drop_outliers(widened, 1).where("customer_id = 'far'").isEmpty()


def test_sweep_prefers_three_groups(base):
    sweep = clustering.sweep_k(base, [2, 3, 4, 5]).cache()
    best = clustering.choose_k(sweep).where("best").first()
    assert (best["k"], best["votes"]) == (3, 3)
    gains = {r["k"]: r["gain"] for r in clustering.height_gain(sweep).collect()}
    assert set(gains) == {2, 3, 4}
    assert gains[2] == max(gains.values())


def test_standardised_features(base):
    row = clustering.standardise(base).agg({"monetary": "stddev"}).first()
    assert row[0] == pytest.approx(1.0)


def _plain_indices(points, labels):
    """Calinski-Harabasz, Davies-Bouldin and the silhouette on squared distances, by pairs."""
    groups = {c: points[labels == c] for c in sorted(set(labels))}
    centers = {c: g.mean(axis=0) for c, g in groups.items()}
    within = sum(((g - centers[c]) ** 2).sum() for c, g in groups.items())
    between = sum(len(g) * ((centers[c] - points.mean(axis=0)) ** 2).sum() for c, g in groups.items())
    ratio = (between / (len(groups) - 1)) / (within / (len(points) - len(groups)))
    far = {c: np.sqrt(((g - centers[c]) ** 2).sum(axis=1)).mean() for c, g in groups.items()}
    bouldin = np.mean([
        max((far[c] + far[d]) / np.linalg.norm(centers[c] - centers[d]) for d in groups if d != c)
        for c in groups
    ])
    shown = []
    for point, own in zip(points, labels):
        gaps = {c: ((g - point) ** 2).sum(axis=1) for c, g in groups.items()}
        n = len(groups[own])
        if n == 1:
            shown.append(0.0)
            continue
        a, b = gaps[own].sum() / (n - 1), min(g.mean() for c, g in gaps.items() if c != own)
        shown.append((b - a) / max(a, b))
    return within, np.mean(shown), ratio, bouldin


def test_a_sweep_equals_clusters_of_one_k_at_a_time(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(m, 1.0, (20, 3)) for m in (0, 8, 20)] + [[[90.0, 0, 50]]])
    base = spark.createDataFrame(
        [(f"c{i}", *map(float, p)) for i, p in enumerate(points)],
        "customer_id string, recency double, frequency double, monetary double",
    )
    sweep = {r["k"]: r for r in clustering.repeatable_sweep(base, (1, 2, 3, 4)).collect()}
    for k in (2, 3, 4):
        seeds = [(2 * i + 1) / (2 * k) for i in range(k)]
        rows = clustering.lloyd_clusters(base, seeds, 3).collect()
        at = np.array([[r["recency"], r["frequency"], r["monetary"]] for r in rows])
        want = _plain_indices(at, np.array([r["cluster"] for r in rows]))
        np.testing.assert_allclose(list(sweep[k])[1:], want, rtol=1e-9)
    assert list(sweep[1])[2:] == [0.0, None, None]
    assert clustering.repeatable_sweep(base.limit(0)).isEmpty()
