"""Queries for customer clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.operators import agglomeration, cluster_choice, clustering
from tillscope.plans.registry import query, rounded
from tillscope.plans.views import ANALYSIS_DATE, quantile, sql
from tillscope.session import materialise
from tillscope.plans.test_tables import order_lines
from tillscope.sources.order_lines import VALUE

_FEATURES = clustering.FEATURES
_SEEDS = (0.125, 0.375, 0.625, 0.875)
_ROUNDS = 3
_DISTANCE = " + ".join(f"pow(c.{f} - m.{f}, 2)" for f in _FEATURES)

_FAR = {
    "far": f"""
        SELECT c.*, sqrt({_DISTANCE}) AS distance FROM customers c
        CROSS JOIN (SELECT {', '.join(f'avg({f}) AS {f}' for f in _FEATURES)} FROM customers) m""",
}
_INLIERS = {
    **_FAR,
    "inliers": """
        SELECT customer_id, recency, frequency, monetary FROM far WHERE customer_id NOT IN
            (SELECT customer_id FROM far ORDER BY distance DESC, customer_id LIMIT 5)""",
}


def _seeds_sql(table: str, columns: str, seeds, number: str, by: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}CAST({i} AS BIGINT) AS {number}, avg(recency) AS recency, "
        f"avg(frequency) AS frequency, {quantile('list(monetary ORDER BY monetary)', p)} AS monetary "
        f"FROM {table}{by}"
        for i, p in enumerate(seeds, start=1)
    )


def _centers_sql(centers: str, assigned: str, keys: str) -> str:
    """New centres; one that lost all its rows stays where it was."""
    means = ", ".join(f"coalesce(avg(a.{f}), any_value(m.{f})) AS {f}" for f in _FEATURES)
    group = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return (
        f"SELECT {group}, {means} FROM {centers} m LEFT JOIN {assigned} a USING ({keys}) "
        f"GROUP BY {group}"
    )


def _lloyd_blocks(seeds=_SEEDS, tag: str = "") -> dict[str, str]:
    blocks = {f"m{tag}0": _seeds_sql("inliers", "", seeds, "cluster")}
    for i in range(_ROUNDS + 1):
        blocks[f"a{tag}{i}"] = f"""
            SELECT c.customer_id, c.recency, c.frequency, c.monetary,
                   arg_min(m.cluster, {_DISTANCE}) AS cluster
            FROM inliers c CROSS JOIN m{tag}{i} m GROUP BY ALL"""
        if i < _ROUNDS:
            blocks[f"m{tag}{i + 1}"] = _centers_sql(f"m{tag}{i}", f"a{tag}{i}", "cluster")
    blocks[f"labelled{tag}"] = f"SELECT * FROM a{tag}{_ROUNDS}"
    return blocks


def _divisive_blocks(levels: int = 2, seeds=(0.25, 0.75)) -> dict[str, str]:
    blocks = {"l0": "SELECT *, CAST(1 AS BIGINT) AS cluster FROM inliers"}
    for level in range(levels):
        blocks[f"c{level}_0"] = _seeds_sql(
            f"l{level}", "cluster, ", seeds, "side", " GROUP BY cluster"
        )
        for i in range(_ROUNDS + 1):
            blocks[f"s{level}_{i}"] = f"""
                SELECT c.customer_id, c.recency, c.frequency, c.monetary, c.cluster,
                       arg_min(m.side, {_DISTANCE}) AS side
                FROM l{level} c JOIN c{level}_{i} m ON m.cluster = c.cluster GROUP BY ALL"""
            if i < _ROUNDS:
                blocks[f"c{level}_{i + 1}"] = _centers_sql(
                    f"c{level}_{i}", f"s{level}_{i}", "cluster, side"
                )
        blocks[f"l{level + 1}"] = (
            f"SELECT * REPLACE (2 * (cluster - 1) + side AS cluster) FROM s{level}_{_ROUNDS}"
        )
    blocks["divided"] = f"SELECT * FROM l{levels}"
    return blocks


_LLOYD = {**_INLIERS, **_lloyd_blocks()}
_DIVISIVE = _divisive_blocks()


def _base(spark, root):
    lines = order_lines(spark, root, ["customer_id", "order_id", "date", VALUE])
    return clustering.cluster_base(lines, ANALYSIS_DATE)


def _inliers(spark, root):
    return clustering.drop_outliers(materialise(_base(spark, root)))


def _lloyd(spark, root):
    return clustering.lloyd_clusters(_inliers(spark, root), _SEEDS, _ROUNDS)


@query(
    "clu_centroid_distance",
    sql("customers", "SELECT customer_id, round(distance, 4) AS distance FROM far", **_FAR),
)
def clu_centroid_distance(spark, root):
    far = clustering.centroid_distance(_base(spark, root))
    return rounded(far.select("customer_id", "distance"), distance=4)


@query(
    "clu_top_outliers",
    sql("customers", "SELECT customer_id, round(distance, 4) AS distance, recency, frequency, "
        "round(monetary, 4) AS monetary FROM far ORDER BY far.distance DESC, customer_id LIMIT 10",
        **_FAR),
)
def clu_top_outliers(spark, root):
    return rounded(clustering.top_outliers(_base(spark, root)), distance=4, monetary=4)


@query(
    "clu_drop_outliers",
    sql("customers", "SELECT customer_id, recency, frequency, round(monetary, 4) AS monetary "
        "FROM inliers", **_INLIERS),
)
def clu_drop_outliers(spark, root):
    return rounded(_inliers(spark, root), monetary=4)


@query(
    "clu_hierarchical",
    sql("customers", "SELECT customer_id, cluster FROM divided", **_INLIERS, **_DIVISIVE),
)
def clu_hierarchical(spark, root):
    return clustering.divisive_clusters(_inliers(spark, root)).select("customer_id", "cluster")


@query(
    "clu_lloyd_fixed",
    sql("customers", "SELECT customer_id, cluster FROM labelled", **_LLOYD),
)
def clu_lloyd_fixed(spark, root):
    return _lloyd(spark, root).select("customer_id", "cluster")


@query(
    "clu_sizes",
    sql("customers", "SELECT cluster, count(*) AS customers FROM labelled GROUP BY cluster", **_LLOYD),
)
def clu_sizes(spark, root):
    return clustering.cluster_sizes(_lloyd(spark, root))


_PROFILE = (
    "SELECT cluster, round(avg(recency), 6) AS recency, round(avg(frequency), 6) AS frequency, "
    "round(avg(monetary), 4) AS monetary FROM labelled GROUP BY cluster"
)


@query("clu_profile", sql("customers", _PROFILE, **_LLOYD))
def clu_profile(spark, root):
    profile = clustering.cluster_profile(_lloyd(spark, root))
    return rounded(profile, recency=6, frequency=6, monetary=4)


@query("agg_cluster_means", sql("customers", _PROFILE.replace("monetary), 4", "monetary), 3"), **_LLOYD))
def agg_cluster_means(spark, root):
    means = _lloyd(spark, root).groupBy("cluster").agg(*[F.avg(f).alias(f) for f in _FEATURES])
    return rounded(means, recency=6, frequency=6, monetary=3)


def _anova_sql() -> str:
    parts = []
    for f in _FEATURES:
        parts.append(
            f"SELECT '{f}' AS variable, count(DISTINCT cluster) - 1 AS df_between, "
            f"count(*) - count(DISTINCT cluster) AS df_within, "
            f"sum(pow(g - a, 2)) AS ss_between, sum(pow(v - g, 2)) AS ss_within FROM "
            f"(SELECT cluster, {f} AS v, avg({f}) OVER (PARTITION BY cluster) AS g, "
            f"avg({f}) OVER () AS a FROM labelled)"
        )
    digits = "round({0} / pow(10, floor(log10({0}))), 8) * pow(10, floor(log10({0})))"
    named = {
        "ss_between": "ss_between",
        "ss_within": "ss_within",
        "ms_between": "(ss_between / df_between)",
        "ms_within": "(ss_within / df_within)",
        "f_value": "((ss_between / df_between) / (ss_within / df_within))",
    }
    return (
        "SELECT variable, df_between, df_within, "
        + ", ".join(f"{digits.format(value)} AS {name}" for name, value in named.items())
        + " FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


@query("clu_anova", sql("customers", _anova_sql(), **_LLOYD))
def clu_anova(spark, root):
    """The whole table, to nine significant digits."""
    table = clustering.anova(_lloyd(spark, root))

    def digits(name):
        size = F.pow(F.lit(10.0), F.floor(F.log10(name)))
        return F.round(F.col(name) / size, 8) * size

    measures = ["ss_between", "ss_within", "ms_between", "ms_within", "f_value"]
    return table.select(
        "variable", "df_between", "df_within", *[digits(m).alias(m) for m in measures]
    )


_SQUARES = " + ".join(f"pow(l.{f} - c.{f}, 2)" for f in _FEATURES)
_GAPS = " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in _FEATURES)
_POINT = " + ".join(f"l.{f} * l.{f}" for f in _FEATURES)
_INNER = " + ".join(f"l.{f} * m.s_{f}" for f in _FEATURES)


def _index_blocks(tag: str = "") -> dict[str, str]:
    """The indices of ``labelled<tag>`` as the one row ``indices<tag>``."""
    t = tag
    return {
        f"centers{t}": "SELECT cluster, count(*) AS n, avg(recency) AS recency, "
        f"avg(frequency) AS frequency, avg(monetary) AS monetary FROM labelled{t} GROUP BY cluster",
        f"grand{t}": "SELECT avg(recency) AS recency, avg(frequency) AS frequency, "
        f"avg(monetary) AS monetary FROM labelled{t}",
        f"spread{t}": f"""
            SELECT c.cluster, c.recency, c.frequency, c.monetary,
                   avg(sqrt({_SQUARES})) AS s, sum({_SQUARES}) AS w
            FROM labelled{t} l JOIN centers{t} c ON c.cluster = l.cluster GROUP BY ALL""",
        f"between_squares{t}": "SELECT sum(c.n * ("
        + " + ".join(f"pow(c.{f} - g.{f}, 2)" for f in _FEATURES)
        + f")) AS b FROM centers{t} c CROSS JOIN grand{t} g",
        f"worst{t}": f"""
            SELECT a.cluster, max((a.s + b.s) / sqrt({_GAPS})) AS w
            FROM spread{t} a JOIN spread{t} b ON a.cluster <> b.cluster GROUP BY a.cluster""",
        f"moments{t}": f"""
            SELECT cluster, count(*) AS n, sum({_POINT}) AS q,
                   {', '.join(f'sum({f}) AS s_{f}' for f in _FEATURES)}
            FROM labelled{t} l GROUP BY cluster""",
        f"gaps{t}": f"""
            SELECT l.customer_id, l.cluster = m.cluster AS own, m.n,
                   {_POINT} + m.q / m.n - 2 * ({_INNER}) / m.n AS d
            FROM labelled{t} l CROSS JOIN moments{t} m""",
        f"sides{t}": f"""
            SELECT max(n) FILTER (own) AS n, max(d * n / (n - 1)) FILTER (own AND n > 1) AS a,
                   min(d) FILTER (NOT own) AS b
            FROM gaps{t} GROUP BY customer_id""",
        f"indices{t}": f"""
            SELECT w AS within_ss,
                   (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)
                    FROM sides{t}) AS silhouette,
                   b / (k - 1) / (w / (n - k)) AS calinski_harabasz,
                   (SELECT avg(w) FROM worst{t}) AS davies_bouldin
            FROM between_squares{t} CROSS JOIN
                 (SELECT sum(w) AS w, count(*) AS k, (SELECT count(*) FROM labelled{t}) AS n
                  FROM spread{t})""",
    }


_KS = range(2, 9)
_SWEEP = {
    **_INLIERS,
    **{
        name: block
        for k in _KS
        for name, block in {
            **_lloyd_blocks([(2 * i + 1) / (2 * k) for i in range(k)], f"_k{k}_"),
            **_index_blocks(f"_k{k}_"),
        }.items()
    },
    "sweep": " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS k, * FROM indices_k{k}_" for k in _KS
    ),
}


@query(
    "clu_validity_indices",
    sql("customers", "SELECT round(calinski_harabasz, 5) AS calinski_harabasz, "
        "round(davies_bouldin, 8) AS davies_bouldin, round(silhouette, 7) AS silhouette "
        "FROM indices", **_LLOYD, **_index_blocks()),
)
def clu_validity_indices(spark, root):
    """The indices behind the choice of k, on the repeatable clusters."""
    indices = clustering.validity_indices(_lloyd(spark, root))
    return rounded(indices, calinski_harabasz=5, davies_bouldin=8, silhouette=7)


@query(
    "clu_height_gain",
    sql("customers", "SELECT k, round(height / 1e6, 3) AS height, "
        "CASE WHEN k < 7 THEN round(gain, 6) END AS gain FROM "
        "(SELECT k, height, height / coalesce(sum(height) OVER (ORDER BY k DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS gain FROM "
        "(SELECT k, within_ss - lead(within_ss) OVER (ORDER BY k) AS height FROM sweep) "
        "WHERE height IS NOT NULL)", **_SWEEP),
)
def clu_height_gain(spark, root):
    """Heights in millions; the first merge has no earlier one to compare with."""
    gains = clustering.height_gain(clustering.repeatable_sweep(_inliers(spark, root)))
    shown = {
        "height": F.col("height") / 1e6,
        "gain": F.when(F.col("k") < max(_KS) - 1, F.col("gain")),
    }
    return rounded(gains.withColumns(shown), height=3, gain=6)


@query(
    "clu_choose_k",
    sql("customers", "SELECT k, round(silhouette, 7) AS silhouette, "
        "round(calinski_harabasz, 4) AS calinski_harabasz, "
        "round(davies_bouldin, 7) AS davies_bouldin, votes, "
        "row_number() OVER (ORDER BY votes DESC, k) = 1 AS best FROM "
        "(SELECT *, CAST(k = (SELECT k FROM sweep ORDER BY silhouette DESC, k LIMIT 1) AS BIGINT) "
        "+ CAST(k = (SELECT k FROM sweep ORDER BY calinski_harabasz DESC, k LIMIT 1) AS BIGINT) "
        "+ CAST(k = (SELECT k FROM sweep ORDER BY davies_bouldin, k LIMIT 1) AS BIGINT) AS votes "
        "FROM sweep)", **_SWEEP),
)
def clu_choose_k(spark, root):
    chosen = clustering.choose_k(clustering.repeatable_sweep(_inliers(spark, root)))
    return rounded(
        chosen.drop("within_ss"), silhouette=7, calinski_harabasz=4, davies_bouldin=7
    )


@query(
    "clu_alt_linkage",
    sql("customers", "SELECT d.cluster, l.cluster AS other_cluster, count(*) AS customers "
        "FROM divided d JOIN labelled l USING (customer_id) GROUP BY ALL", **_LLOYD, **_DIVISIVE),
)
def clu_alt_linkage(spark, root):
    base = materialise(_inliers(spark, root))
    return clustering.cross_tab(
        clustering.divisive_clusters(base),
        clustering.lloyd_clusters(base, _SEEDS, _ROUNDS),
    )


# Merge trees and a second linkage. Money without the noise of sums, so that both engines see equal boxes.
_CENTS = {
    **_INLIERS,
    "cents": "SELECT customer_id, recency, frequency, round(monetary, 4) AS monetary FROM inliers",
}
_LEVELS, _BOUND = agglomeration.LEVELS, agglomeration.BOUND


def _cents(spark, root):
    return materialise(rounded(_inliers(spark, root), monetary=4))


def _feature_blocks() -> dict[str, str]:
    numbers = range(len(_FEATURES))
    side = 1 << _LEVELS
    place = ", ".join(
        f"least(CAST(floor(coalesce(({f} - lo{i}) / nullif(hi{i} - lo{i}, 0), 0) * {side}) AS BIGINT), "
        f"{side - 1}) AS q{i}, {f} - lo{i} AS x{i}"
        for i, f in enumerate(_FEATURES)
    )
    bounds = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(_FEATURES))
    up = ", ".join(f"q{i} >> ({_LEVELS} - level) AS p{i}" for i in numbers)
    sums = ", ".join(f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS sq{i}" for i in numbers)
    spread = " + ".join(f"(sq{i} - s{i} * s{i} / n)" for i in numbers)
    around = " AND ".join(f"c.p{i} >> 1 = a.p{i}" for i in numbers)
    return {
        "box": f"SELECT {bounds} FROM cents",
        "placed": f"SELECT {place} FROM cents CROSS JOIN box",
        "sums": f"SELECT CAST(level AS BIGINT) AS level, {up}, count(*) AS n, {sums} "
        f"FROM placed CROSS JOIN range({_LEVELS + 1}) t(level) GROUP BY ALL",
        "cells": f"SELECT *, CASE WHEN n = 1 OR level = {_LEVELS} THEN 0 ELSE greatest({spread}, 0) END "
        "AS scatter FROM sums",
        "nested": "SELECT c.*, coalesce(a.scatter, 'inf'::DOUBLE) AS around FROM cells c "
        f"LEFT JOIN cells a ON c.level = a.level + 1 AND {around}",
        "limits": "SELECT i, (SELECT max(scatter) FROM cells) / pow(2, i) AS allowed "
        f"FROM range({agglomeration.HALVINGS + 1}) t(i)",
        "chosen": "SELECT max_by(allowed, i) AS allowed FROM (SELECT i, any_value(allowed) AS allowed "
        "FROM limits JOIN nested ON scatter <= allowed AND around > allowed "
        f"GROUP BY i HAVING count(*) <= {_BOUND})",
        "features": "SELECT n.* FROM nested n CROSS JOIN chosen WHERE CASE "
        f"WHEN (SELECT count(*) FROM cells WHERE level = {_LEVELS}) <= {_BOUND} "
        f"THEN level = {_LEVELS} ELSE scatter <= allowed AND around > allowed END",
    }


@query(
    "clu_features",
    sql("customers", "SELECT level, p0, p1, p2, n, "
        + ", ".join(f"round(lo{i} * n + s{i}, 4) AS sum_{f}" for i, f in enumerate(_FEATURES))
        + " FROM features CROSS JOIN box", **_CENTS, **_feature_blocks()),
)
def clu_features(spark, root):
    """The clustering features that the merges start from."""
    found = agglomeration.clustering_features(_cents(spark, root))
    return found.select(
        F.col("level").cast("long").alias("level"),
        *[F.col("place")[i].alias(f"p{i}") for i in range(len(_FEATURES))],
        "n",
        *[F.round(F.col("mean")[i] * F.col("n"), 4).alias(f"sum_{f}") for i, f in enumerate(_FEATURES)],
    )


def _tree(spark, root):
    features = materialise(agglomeration.clustering_features(_cents(spark, root)))
    return agglomeration.merge_tree(features)


@query("clu_ward_tree")
def clu_ward_tree(spark, root):
    """The merge tree: the nodes joined at each step, the height and the customers below."""
    return _tree(spark, root)


@query("clu_ward_gain")
def clu_ward_gain(spark, root):
    """The last ten merge heights over the sum of all before."""
    return agglomeration.merge_gain(_tree(spark, root))


@query("clu_ward_clusters")
def clu_ward_clusters(spark, root):
    """The tree cut at four clusters, for every customer."""
    labelled = agglomeration.ward_clusters(_cents(spark, root))
    return labelled.select("customer_id", "cluster")


@query("clu_ward_profile")
def clu_ward_profile(spark, root):
    """Size and feature means of the four Ward clusters."""
    labelled = materialise(agglomeration.ward_clusters(_cents(spark, root)))
    return clustering.cluster_sizes(labelled).join(clustering.cluster_profile(labelled), "cluster")


def _farthest_blocks(k: int = 4) -> dict[str, str]:
    means = ", ".join(f"avg({f}) AS {f}" for f in _FEATURES)
    blocks = {
        "reach0": f"SELECT c.*, sqrt({_DISTANCE}) AS reach FROM cents c "
        f"CROSS JOIN (SELECT {means} FROM cents) m"
    }
    for i in range(1, k + 1):
        blocks[f"far{i}"] = (
            f"SELECT {', '.join(_FEATURES)} FROM reach{i - 1} ORDER BY reach DESC, customer_id LIMIT 1"
        )
        seen = " UNION ALL ".join(f"SELECT {j} AS number, * FROM far{j}" for j in range(1, i + 1))
        blocks[f"reach{i}"] = (
            f"SELECT c.customer_id, {', '.join(f'c.{f}' for f in _FEATURES)}, "
            f"min(sqrt({_DISTANCE})) AS reach, CAST(arg_min(m.number, (sqrt({_DISTANCE}), m.number)) "
            f"AS BIGINT) AS cluster FROM cents c CROSS JOIN ({seen}) m GROUP BY ALL"
        )
    blocks["spanned"] = f"SELECT * FROM reach{k}"
    return blocks


@query(
    "clu_farthest_first",
    sql("customers", "SELECT cluster, count(*) AS customers, round(max(reach), 4) AS radius, "
        "round(avg(reach), 4) AS mean_distance FROM spanned GROUP BY cluster",
        **_CENTS, **_farthest_blocks()),
)
def clu_farthest_first(spark, root):
    """The complete-linkage companion: four clusters of small diameter."""
    labelled = cluster_choice.farthest_first(_cents(spark, root))
    return rounded(cluster_choice.linkage_radii(labelled), radius=4, mean_distance=4)


@query(
    "clu_linkage_crosstab",
    sql("customers", "SELECT f.cluster, l.cluster AS other_cluster, count(*) AS customers "
        "FROM spanned f JOIN labelled l USING (customer_id) GROUP BY ALL",
        **{**_LLOYD, "cents": _CENTS["cents"], **_farthest_blocks()}),
)
def clu_linkage_crosstab(spark, root):
    """Customers by farthest-first cluster and fixed Lloyd cluster."""
    return clustering.cross_tab(
        cluster_choice.farthest_first(_cents(spark, root)), _lloyd(spark, root)
    )


_GAP_KS, _GAP_DRAWS = range(1, 7), 4


def _gap_blocks() -> dict[str, str]:
    prime, by_draw = cluster_choice._PRIME, cluster_choice._BY_DRAW

    def drawn(f: str, i: int) -> str:
        mixed = (
            f"((CAST(customer_id AS BIGINT) % {prime}) * {cluster_choice._BY_ID[i]} "
            f"+ (draw + 1) * {by_draw + i}) % {prime}"
        )
        cubed = f"(({mixed}) * ({mixed}) % {prime}) * ({mixed}) % {prime}"
        return (
            f"CASE WHEN draw = 0 THEN CAST({f} AS DOUBLE) ELSE "
            f"lo{i} + (hi{i} - lo{i}) * (({cubed}) / {float(prime)}) END AS {f}"
        )

    names = list(_FEATURES)
    blocks = {
        "box": "SELECT " + ", ".join(
            f"CAST(min({f}) AS DOUBLE) AS lo{i}, CAST(max({f}) AS DOUBLE) AS hi{i}"
            for i, f in enumerate(names)
        ) + " FROM cents",
        "pts": "SELECT customer_id, draw, " + ", ".join(drawn(f, i) for i, f in enumerate(names))
        + f" FROM cents CROSS JOIN box CROSS JOIN range({_GAP_DRAWS + 1}) t(draw)",
        "g0": "SELECT draw, k, cluster, " + ", ".join(
            f"lo_{f} + (2 * cluster - 1) / (2.0 * k) * (hi_{f} - lo_{f}) AS {f}" for f in names
        ) + " FROM (SELECT draw, " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in names)
        + " FROM pts GROUP BY draw) CROSS JOIN (SELECT k, unnest(range(1, k + 1)) AS cluster "
        f"FROM range({_GAP_KS.start}, {_GAP_KS.stop}) t(k))",
    }
    for i in range(_ROUNDS + 1):
        blocks[f"b{i}"] = f"""
            SELECT c.customer_id, c.draw, m.k, any_value(c.recency) AS recency,
                   any_value(c.frequency) AS frequency, any_value(c.monetary) AS monetary,
                   min({_DISTANCE}) AS least, arg_min(m.cluster, ({_DISTANCE}, m.cluster)) AS cluster
            FROM pts c JOIN g{i} m ON m.draw = c.draw GROUP BY c.customer_id, c.draw, m.k"""
        if i < _ROUNDS:
            blocks[f"g{i + 1}"] = _centers_sql(f"g{i}", f"b{i}", "draw, k, cluster")
    blocks["logs"] = f"SELECT draw, k, ln(sum(least)) AS w FROM b{_ROUNDS} GROUP BY draw, k"
    blocks["gaps"] = f"""
        SELECT k, any_value(w) FILTER (draw = 0) AS log_within, avg(w) FILTER (draw > 0) AS expected,
               avg(w) FILTER (draw > 0) - any_value(w) FILTER (draw = 0) AS gap,
               stddev_pop(w) FILTER (draw > 0) * sqrt(1 + 1.0 / {_GAP_DRAWS}) AS spread
        FROM logs GROUP BY k"""
    blocks["marked"] = """
        SELECT *, gap >= lead(gap) OVER (ORDER BY k) - lead(spread) OVER (ORDER BY k) AS good FROM gaps"""
    return blocks


@query(
    "clu_gap_statistic",
    sql("customers", "SELECT k, round(log_within, 6) AS log_within, round(expected, 6) AS expected, "
        "round(gap, 6) AS gap, round(spread, 6) AS spread, "
        "k = coalesce((SELECT min(k) FROM marked WHERE good), (SELECT max(k) FROM marked)) AS best "
        "FROM marked", **_CENTS, **_gap_blocks()),
)
def clu_gap_statistic(spark, root):
    """How much tighter the clusters are than those of uniform draws, by their number."""
    found = cluster_choice.gap_statistic(
        _cents(spark, root), list(_GAP_KS), _GAP_DRAWS, _ROUNDS, F.col("customer_id").cast("long")
    )
    return rounded(found, log_within=6, expected=6, gap=6, spread=6)


_THREE = (1 / 6, 0.5, 5 / 6)


@query(
    "clu_anova_p",
    sql("customers", "SELECT variable, df_between, df_within, "
        "round(df_within / 2 * log10(df_within / (df_within + 2 * f_value)), 5) AS log10_p "
        f"FROM ({_anova_sql().replace('FROM labelled)', 'FROM labelled_three_)')})",
        **_INLIERS, **_lloyd_blocks(_THREE, "_three_")),
)
def clu_anova_p(spark, root):
    """P-values of the analysis of variance of three clusters, where the tail has a closed form."""
    labelled = clustering.lloyd_clusters(_inliers(spark, root), _THREE, _ROUNDS)
    table = cluster_choice.anova_with_p(labelled)
    return table.select("variable", "df_between", "df_within", F.round("log10_p", 5).alias("log10_p"))
