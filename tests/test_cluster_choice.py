"""Farthest-first centres, the gap statistic and F tails against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.functions.special import log_f_tail
from tillscope.operators import cluster_choice, clustering

_SCHEMA = "customer_id string, recency double, frequency double, monetary double"


def _base(spark, seed=1, groups=4, n=50, spread=5.0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(0, 1000, (groups, 3))
    rows = [
        (f"c{g}_{i}", *(float(v) for v in centers[g] + rng.normal(0, spread, 3)))
        for g in range(groups)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, _SCHEMA), rows


def test_farthest_first_equals_the_plain_traversal(spark):
    base, rows = _base(spark, spread=60.0)
    points = {r[0]: np.array(r[1:]) for r in rows}
    mean = np.mean(list(points.values()), axis=0)
    reach = {c: float(np.linalg.norm(p - mean)) for c, p in points.items()}
    centers = []
    for _ in range(5):
        centers.append(min(points, key=lambda c: (-reach[c], c)))
        reach = {
            c: min(float(np.linalg.norm(p - points[m])) for m in centers) for c, p in points.items()
        }
    found = cluster_choice.farthest_first(base, 5).collect()
    for r in found:
        assert r["distance"] == pytest.approx(reach[r["customer_id"]], abs=1e-9)
        own = points[centers[r["cluster"] - 1]]
        assert np.linalg.norm(points[r["customer_id"]] - own) == pytest.approx(r["distance"], abs=1e-9)
    assert len(found) == len(rows)


def test_separated_groups_are_the_clusters(spark):
    base, _ = _base(spark)
    labelled = cluster_choice.farthest_first(base, 4)
    groups = {}
    for r in labelled.collect():
        groups.setdefault(r["cluster"], set()).add(r["customer_id"].split("_")[0])
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1, 1]
    radii = cluster_choice.linkage_radii(labelled).collect()
    assert sum(r["customers"] for r in radii) == 200
    assert all(0 < r["mean_distance"] < r["radius"] < 80 for r in radii)


def test_few_equal_and_no_rows(spark):
    rows = [("a", 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0), ("c", 5.0, 1.0, 1.0)]
    base = spark.createDataFrame(rows, _SCHEMA)
    found = cluster_choice.farthest_first(base, 4).collect()
    assert len({r["cluster"] for r in found}) == 2 and max(r["distance"] for r in found) == 0
    empty = cluster_choice.farthest_first(base.limit(0), 4)
    assert empty.isEmpty() and "cluster" in empty.columns
    assert cluster_choice.gap_statistic(base.limit(0)).isEmpty()
    same = cluster_choice.gap_statistic(base.limit(1), [1, 2]).collect()
    assert [r["gap"] for r in same] == [None, None]


def _plain_gap(rows, ks, draws, rounds):
    """The same fixed draws and rounds, with numpy."""
    data = np.array([r[1:] for r in rows])
    number = [r[0] for r in rows]
    low, high = data.min(axis=0), data.max(axis=0)
    prime, tables = cluster_choice._PRIME, [data]
    for draw in range(1, draws + 1):
        table = []
        for n in number:
            row = []
            for i in range(3):
                m = (n % prime * cluster_choice._BY_ID[i] + (draw + 1) * (cluster_choice._BY_DRAW + i)) % prime
                row.append(low[i] + (high[i] - low[i]) * (m**3 % prime / prime))
            table.append(row)
        tables.append(np.array(table))
    logs = {}
    for d, points in enumerate(tables):
        lo, hi = points.min(axis=0), points.max(axis=0)
        for k in ks:
            centers = np.array([lo + (2 * n - 1) / (2 * k) * (hi - lo) for n in range(1, k + 1)])
            for _ in range(rounds):
                label = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
                centers = np.array(
                    [points[label == c].mean(axis=0) if (label == c).any() else centers[c] for c in range(k)]
                )
            logs[d, k] = math.log(((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum())
    return logs


def test_gap_statistic_equals_the_plain_version(spark):
    _, rows = _base(spark, seed=4, groups=3, n=30)
    rows = [(n * 7 + 1, *r[1:]) for n, r in enumerate(rows)]
    base = spark.createDataFrame(rows, _SCHEMA.replace("string", "long"))
    ks, draws = [1, 2, 3, 4, 5], 3
    logs = _plain_gap(rows, ks, draws, 3)
    found = cluster_choice.gap_statistic(base, ks, draws, 3, F.col("customer_id")).collect()
    gaps, spreads = {}, {}
    for r in found:
        own = [logs[d, r["k"]] for d in range(1, draws + 1)]
        gaps[r["k"]], spreads[r["k"]] = np.mean(own) - logs[0, r["k"]], np.std(own) * math.sqrt(1 + 1 / draws)
        assert r["log_within"] == pytest.approx(logs[0, r["k"]])
        assert (r["gap"], r["spread"]) == (pytest.approx(gaps[r["k"]]), pytest.approx(spreads[r["k"]]))
    best = next((k for k in ks[:-1] if gaps[k] >= gaps[k + 1] - spreads[k + 1]), ks[-1])
    assert [r["k"] for r in found if r["best"]] == [best]


def _tail(spark, rows):
    frame = spark.createDataFrame(rows, "f double, a long, b long")
    found = frame.select("f", "a", "b", log_f_tail(F.col("f"), F.col("a"), F.col("b")).alias("t"))
    return {(r["f"], r["a"], r["b"]): r["t"] for r in found.collect()}


def test_f_tails_equal_closed_forms_and_tables(spark):
    rows = [(f, 2, b) for f in (0.0, 0.01, 0.5, 1.0, 3.0, 50.0, 4000.0) for b in (1, 2, 7, 117, 100_000)]
    for (f, _, b), t in _tail(spark, rows).items():
        assert t == pytest.approx(b / 2 * math.log(b / (b + 2 * f)), rel=1e-9, abs=1e-9)
    # Swapping the degrees of freedom turns the tail around.
    pairs = [(f, a, b) for f in (0.2, 1.0, 4.0) for a in (1, 3, 8, 300) for b in (1, 5, 40, 700)]
    upper = _tail(spark, pairs)
    lower = _tail(spark, [(1 / f, b, a) for f, a, b in pairs])
    for f, a, b in pairs:
        assert math.exp(upper[f, a, b]) + math.exp(lower[1 / f, b, a]) == pytest.approx(1, abs=1e-10)
    # Tabulated 5 and 1 percent points.
    for f, a, b, p in ((3.4928, 2, 20, 0.05), (2.8661, 4, 20, 0.05), (5.8489, 2, 20, 0.01), (3.8415, 1, 10**7, 0.05)):
        assert math.exp(_tail(spark, [(f, a, b)])[f, a, b]) == pytest.approx(p, rel=2e-4)


def test_f_tails_by_quadrature(spark):
    for a, b, f in ((3, 17, 2.5), (5, 400, 1.3), (12, 9, 0.7)):
        t = np.linspace(0, 1, 2_000_001)[1:-1]
        x = f + t / (1 - t)
        log_density = (
            math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)
            + a / 2 * math.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b)
        )
        p = np.trapezoid(np.exp(log_density) / (1 - t) ** 2, t)
        assert math.exp(_tail(spark, [(f, a, b)])[f, a, b]) == pytest.approx(p, rel=1e-6)


def test_anova_gets_p_values_and_marks(spark):
    base, rows = _base(spark, groups=3, n=40)
    labelled = clustering.lloyd_clusters(base, [0.1, 0.5, 0.9])
    table = cluster_choice.anova_with_p(labelled)
    for r in table.collect():
        assert r["log10_p"] < -100 and r["p_value"] == pytest.approx(10 ** r["log10_p"], rel=1e-6)
    one = cluster_choice.anova_with_p(base.withColumn("cluster", F.lit(1)))
    assert {r["log10_p"] for r in one.collect()} == {None}
    marks = spark.createDataFrame([(v,) for v in (0.0, 0.005, 0.03, 0.07, 0.5, None)], "p double")
    got = [r[0] for r in marks.select(cluster_choice.significance_stars(F.col("p"))).collect()]
    assert got == ["***", "**", "*", ".", "", None]
