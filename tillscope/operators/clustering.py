"""Customer clusters over recency, frequency and monetary value."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillscope.operators.ordering import top_k
from tillscope.operators.quantiles import exact_quantiles
from tillscope.session import materialise
from tillscope.sources.order_lines import VALUE

FEATURES = ("recency", "frequency", "monetary")
SEED = 123


def cluster_base(lines: DataFrame, analysis_date: dt.date | str) -> DataFrame:
    """Days since the last purchase, distinct orders and total spend per customer."""
    return lines.groupBy("customer_id").agg(
        F.date_diff(F.lit(str(analysis_date)).cast("date"), F.max("date"))
        .cast("long")
        .alias("recency"),
        F.count_distinct("order_id").alias("frequency"),
        F.sum(VALUE).alias("monetary"),
    )


def _squared_distance(center: Mapping[str, Column] | Column, features: Sequence[str]) -> Column:
    terms = [F.pow(F.col(f) - center[f], 2) for f in features]
    return sum(terms[1:], terms[0])


def standardise(base: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Scale features to mean 0 and standard deviation 1 (off by default elsewhere)."""
    moments = base.agg(
        F.struct(
            *[F.avg(f).alias(f"{f}_mean") for f in features],
            *[F.stddev_samp(f).alias(f"{f}_sd") for f in features],
        )
    )
    scaled = base.withColumn("_m", moments.scalar())
    return scaled.withColumns(
        {f: F.try_divide(F.col(f) - F.col(f"_m.{f}_mean"), F.col(f"_m.{f}_sd")) for f in features}
    ).drop("_m")


def centroid_distance(base: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Add the Euclidean distance of each row from the column means."""
    means = base.agg(F.struct(*[F.avg(f).alias(f) for f in features]))
    distance = F.sqrt(_squared_distance(F.col("_mean"), features))
    return base.withColumn("_mean", means.scalar()).withColumn("distance", distance).drop("_mean")


def top_outliers(base: DataFrame, k: int = 10, features: Sequence[str] = FEATURES) -> DataFrame:
    """The k rows farthest from the column means."""
    far = top_k(centroid_distance(base, features), k, "distance", "customer_id")
    return far.select("customer_id", "distance", *features)


def drop_outliers(base: DataFrame, k: int = 5, features: Sequence[str] = FEATURES) -> DataFrame:
    """Remove the k farthest rows; only k ids are broadcast.

    Reads ``base`` three times, and Spark pushes the anti join below the grouping
    that made it: pass a materialised table.
    """
    ids = top_outliers(base, k, features).select("customer_id")
    return base.join(F.broadcast(ids), "customer_id", "left_anti")


def _double(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _square(center: Mapping[str, float], features: Sequence[str]) -> str:
    """SQL for the squared distance to a centre: text is one call to the driver's JVM."""
    return "(" + " + ".join(f"pow(`{f}` - {_double(center[f])}, 2)" for f in features) + ")"


def _nearest(centers: Sequence[Mapping[str, float]], features: Sequence[str]) -> Column:
    """1-based number of the nearest centre; the lower number wins a tie."""
    squares = [_square(c, features) for c in centers]
    if len(squares) == 1:
        return F.lit(1).cast("long")
    best = f"least({', '.join(squares)})"
    cases = " ".join(f"WHEN {d} = {best} THEN {i}" for i, d in enumerate(squares[:-1], start=1))
    return F.expr(f"CAST(CASE {cases} ELSE {len(squares)} END AS BIGINT)")


def lloyd_clusters(
    base: DataFrame,
    quantile_seeds: Sequence[float] = (0.125, 0.375, 0.625, 0.875),
    rounds: int = 3,
    features: Sequence[str] = FEATURES,
    spread: str = "monetary",
) -> DataFrame:
    """Nearest-centre clusters after a fixed number of Lloyd rounds.

    Seeds sit at the feature means, spread over quantiles of one feature, so the
    result is repeatable. Each round is one aggregation that returns k rows.
    """
    return _lloyd(materialise(base), quantile_seeds, rounds, features, spread)


def _lloyd(
    data: DataFrame,
    quantile_seeds: Sequence[float],
    rounds: int,
    features: Sequence[str] = FEATURES,
    spread: str = "monetary",
) -> DataFrame:
    means = data.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    seeds = exact_quantiles(data, [spread], quantile_seeds).first()["quantiles"]
    centers = [{**means, spread: seed} for seed in seeds]
    for _ in range(rounds):
        means = (
            data.groupBy(_nearest(centers, features).alias("cluster"))
            .agg(*[F.avg(f).alias(f) for f in features])
            .collect()
        )
        # A cluster that lost all its rows keeps its old centre.
        for row in means:
            centers[row["cluster"] - 1] = {f: row[f] for f in features}
    return data.withColumn("cluster", _nearest(centers, features))


def divisive_clusters(
    base: DataFrame,
    levels: int = 2,
    rounds: int = 3,
    quantile_seeds: tuple[float, float] = (0.25, 0.75),
    features: Sequence[str] = FEATURES,
    spread: str = "monetary",
) -> DataFrame:
    """Split every cluster in two, ``levels`` times, by Lloyd rounds from fixed seeds.

    The seeds of a cluster sit at its means, at two quantiles of one feature. Each
    round is one aggregation with a row per side; a side that lost all its rows
    keeps its centre.
    """
    data = materialise(base.withColumn("cluster", F.lit(1).cast("long")))
    for _ in range(levels):
        means = data.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in features])
        seeds = exact_quantiles(data, [spread], quantile_seeds, by=["cluster"], few_groups=True)
        centers = {}
        for row in means.join(seeds, "cluster").collect():  # one row per cluster
            for side, value in enumerate(row["quantiles"], start=1):
                own = {f: row[f] for f in features}
                centers[2 * (row["cluster"] - 1) + side] = {**own, spread: value}
        parents = sorted({(c + 1) // 2 for c in centers})

        def side_of(parent: int) -> Column:
            pair = [centers[2 * parent - 1], centers[2 * parent]]
            return 2 * (parent - 1) + _nearest(pair, features)

        def label() -> Column:
            value = F.lit(None).cast("long")
            for parent in parents:
                value = F.when(F.col("cluster") == parent, side_of(parent)).otherwise(value)
            return value

        for _ in range(rounds):
            for row in data.groupBy(label().alias("side")).agg(
                *[F.avg(f).alias(f) for f in features]
            ).collect():
                centers[row["side"]] = {f: row[f] for f in features}
        data = materialise(data.withColumn("cluster", label()))
    return data


def _vectors(base: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(base)


def _labels(model, vectors: DataFrame) -> DataFrame:
    return (
        model.transform(vectors)
        .withColumn("cluster", F.col("prediction").cast("long") + 1)
        .drop("features", "prediction")
    )


def hierarchical_clusters(
    base: DataFrame, k: int = 4, seed: int = SEED, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Clusters from divisive (bisecting) hierarchical k-means on all rows.

    Splits from the top and so is not Ward's agglomeration, which needs all
    pairwise distances.
    """
    vectors = _vectors(materialise(base), features)
    return _labels(BisectingKMeans(k=k, seed=seed).fit(vectors), vectors)


def flat_clusters(
    base: DataFrame, k: int = 4, seed: int = SEED, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Plain k-means clusters, as the second clustering to compare with."""
    vectors = _vectors(materialise(base), features)
    return _labels(KMeans(k=k, seed=seed).fit(vectors), vectors)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("customers"))


def cluster_profile(labelled: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean of every feature per cluster."""
    return labelled.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in features])


def cross_tab(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """Customers by pair of cluster labels from two clusterings."""
    other = right.select(key, F.col("cluster").alias("other_cluster"))
    return (
        left.select(key, "cluster")
        .join(other, key)
        .groupBy("cluster", "other_cluster")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def _group_moments(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows ``(variable, cluster, n, mean, within)``, at most features x clusters."""
    cells = [
        F.struct(
            F.lit(f).alias("variable"),
            F.col("_n").alias("n"),
            F.col(f"_mean_{f}").alias("mean"),
            (F.col(f"_var_{f}") * F.col("_n")).alias("within"),
        )
        for f in features
    ]
    return (
        labelled.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(f).alias(f"_mean_{f}") for f in features],
            *[F.var_pop(f).alias(f"_var_{f}") for f in features],
        )
        .select("cluster", F.inline(F.array(*cells)))
    )


def anova(labelled: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One-way analysis of variance per feature: degrees, squares and F.

    One pass over the rows; the rest works on one row per cluster and feature.
    """
    whole = Window.partitionBy("variable")
    moments = _group_moments(labelled, features).withColumn(
        "_grand", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    )
    return (
        moments.groupBy("variable")
        .agg(
            (F.count(F.lit(1)) - 1).alias("df_between"),
            (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ss_between"),
            F.sum("within").alias("ss_within"),
        )
        .withColumn("ms_between", F.try_divide("ss_between", "df_between"))
        .withColumn("ms_within", F.try_divide("ss_within", "df_within"))
        .withColumn("f_value", F.try_divide("ms_between", "ms_within"))
    )


def validity_indices(labelled: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and silhouette of a clustering, as one row.

    The silhouette takes squared distances, whose mean to a cluster follows from
    its size, sums and sum of squares: one pass, no pairs.
    """
    squares = anova(labelled, features).agg(
        F.sum("ss_between").alias("between"),
        F.sum("ss_within").alias("within"),
        F.max("df_between").alias("df_between"),
        F.max("df_within").alias("df_within"),
    )
    ratio = F.try_divide(
        F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within")
    )
    # One centre per cluster: bounded by the number of clusters.
    centers = cluster_profile(labelled, features).select(
        F.col("cluster").alias("_cluster"), F.struct(*features).alias("_center")
    )
    spreads = (
        labelled.join(F.broadcast(centers), F.col("cluster") == F.col("_cluster"))
        .withColumn("_far", F.sqrt(_squared_distance(F.col("_center"), features)))
        .groupBy("cluster", "_center")
        .agg(F.avg("_far").alias("spread"))
    )
    # All k centres in one row; each is compared with the k-1 others.
    row = spreads.agg(
        F.collect_list(F.struct("cluster", "_center", "spread")).alias("_all")
    )

    def separation(one: Column, two: Column) -> Column:
        gaps = [F.pow(one["_center"][f] - two["_center"][f], 2) for f in features]
        return F.sqrt(sum(gaps[1:], gaps[0]))

    worst = F.transform(
        "_all",
        lambda one: F.array_max(
            F.transform(
                "_all",
                lambda two: F.when(
                    one["cluster"] != two["cluster"],
                    (one["spread"] + two["spread"]) / separation(one, two),
                ),
            )
        ),
    )
    bouldin = row.select(
        (F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.size("_all")).alias("db")
    )
    square = sum((F.col(f) * F.col(f) for f in features[1:]), F.col(features[0]) * F.col(features[0]))
    moments = (
        labelled.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(square).alias("q"),
            *[F.sum(f).alias(f"s_{f}") for f in features],
        )
        .agg(F.collect_list(F.struct("cluster", "n", "q", *[f"s_{f}" for f in features])))
    )  # k entries in one row

    def mean_gap(c: Column) -> Column:
        inner = sum((F.col(f) * c[f"s_{f}"] for f in features[1:]), F.col(features[0]) * c[f"s_{features[0]}"])
        return square + c["q"] / c["n"] - 2 * inner / c["n"]

    own = F.filter("_clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    gaps = labelled.withColumn("_clusters", moments.scalar()).select(
        own["n"].alias("n"),
        F.when(own["n"] > 1, mean_gap(own) * own["n"] / (own["n"] - 1)).alias("a"),
        F.array_min(
            F.transform(
                F.filter("_clusters", lambda c: c["cluster"] != F.col("cluster")), mean_gap
            )
        ).alias("b"),
    )
    silhouette = gaps.agg(
        F.avg(
            F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
        )
    )
    return squares.select(
        ratio.alias("calinski_harabasz"),
        bouldin.scalar().alias("davies_bouldin"),
        silhouette.scalar().alias("silhouette"),
    )


_SWEEP_SCHEMA = (
    "k long, within_ss double, silhouette double, "
    "calinski_harabasz double, davies_bouldin double"
)


def repeatable_sweep(
    base: DataFrame,
    ks: Sequence[int] = tuple(range(2, 9)),
    rounds: int = 3,
    features: Sequence[str] = FEATURES,
    spread: str = "monetary",
) -> DataFrame:
    """``lloyd_clusters`` with k evenly spread quantile seeds for every k, and three indices.

    One row per k, as from ``sweep_k``. All k share their jobs: one call for the
    seeds, one aggregation a round and two for the indices, each with a row per k
    and cluster. An empty table has no rows; an index that is not defined, as for
    one cluster, is null.
    """
    data = materialise(base.select(*[F.col(f).cast("double").alias(f) for f in features]))
    means = data.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    if means[spread] is None:
        return base.sparkSession.createDataFrame([], _SWEEP_SCHEMA)
    shares = sorted({(2 * i + 1) / (2 * k) for k in ks for i in range(k)})
    found = exact_quantiles(data, [spread], shares).first()["quantiles"]
    seeds = dict(zip(shares, found))
    centers = {
        k: [{**means, spread: seeds[(2 * i + 1) / (2 * k)]} for i in range(k)] for k in ks
    }

    def labels() -> dict[str, Column]:
        return {f"_label{k}": _nearest(centers[k], features) for k in ks}

    def by_cluster(labelled: DataFrame, *aggregates: Column) -> list[Row]:
        cells = [F.struct(F.lit(k).alias("k"), F.col(f"_label{k}").alias("cluster")) for k in ks]
        rows = labelled.select(*features, F.inline(F.array(*cells)))
        return rows.groupBy("k", "cluster").agg(*aggregates).collect()  # a row per k and cluster

    for _ in range(rounds):
        for row in by_cluster(data.withColumns(labels()), *[F.avg(f).alias(f) for f in features]):
            centers[row["k"]][row["cluster"] - 1] = {f: row[f] for f in features}
    labelled = materialise(data.withColumns(labels()))
    moments = by_cluster(
        labelled,
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f) for f in features],
        *[F.var_pop(f).alias(f"_var_{f}") for f in features],
    )
    by_k = {k: [row for row in moments if row["k"] == k] for k in ks}
    cells = [_fit_of_row(k, by_k[k], features) for k in ks]
    fits = (
        labelled.select(F.inline(F.array(*cells)))
        .groupBy("k", "cluster")
        .agg(F.avg("far").alias("far"), F.sum("silhouette").alias("silhouette"))
        .collect()  # a row per k and cluster
    )
    rows = [
        _sweep_row(k, by_k[k], {r["cluster"]: r for r in fits if r["k"] == k}, features)
        for k in ks
    ]
    return base.sparkSession.createDataFrame(rows, _SWEEP_SCHEMA)


def _fit_of_row(k: int, clusters: Sequence[Row], features: Sequence[str]) -> Column:
    """A row's cluster among ``k``, its distance to the centre and its silhouette.

    The mean squared distance to a cluster is that to its centre and the cluster's variance.
    """
    label = f"_label{k}"
    far, own, other = [], [], []
    for c in clusters:
        square = _square({f: c[f] for f in features}, features)
        gap = f"({square} + {_double(sum(c[f'_var_{f}'] for f in features))})"
        far.append(f"WHEN {c['cluster']} THEN sqrt({square})")
        if c["n"] > 1:
            own.append(f"WHEN {c['cluster']} THEN {gap} * {_double(c['n'] / (c['n'] - 1))}")
        other.append(f"CASE WHEN {label} != {c['cluster']} THEN {gap} END")
    # A cluster of one row, or the only cluster, has a silhouette of 0.
    silhouette = F.lit(0.0)
    if own and len(other) > 1:
        mine, nearest = f"(CASE {label} {' '.join(own)} END)", f"least({', '.join(other)})"
        silhouette = F.expr(
            f"coalesce(try_divide({nearest} - {mine}, greatest({mine}, {nearest})), 0D)"
        )
    return F.struct(
        F.lit(k).alias("k"),
        F.col(label).alias("cluster"),
        F.expr(f"CASE {label} {' '.join(far)} END").alias("far"),
        silhouette.alias("silhouette"),
    )


def _sweep_row(
    k: int, clusters: Sequence[Row], fits: Mapping[int, Row], features: Sequence[str]
) -> tuple:
    """The row of ``repeatable_sweep`` for one k, from one row per cluster."""
    total = sum(c["n"] for c in clusters)
    grand = {f: sum(c["n"] * c[f] for c in clusters) / total for f in features}
    within = math.fsum(c["n"] * c[f"_var_{f}"] for c in clusters for f in features)
    between = math.fsum(c["n"] * (c[f] - grand[f]) ** 2 for c in clusters for f in features)
    df_between, df_within = len(clusters) - 1, total - len(clusters)
    ratio = bouldin = None
    if df_between and df_within and within:
        ratio = (between / df_between) / (within / df_within)

    def overlap(one: Row, two: Row) -> float:
        apart = math.dist([one[f] for f in features], [two[f] for f in features])
        spreads = fits[one["cluster"]]["far"] + fits[two["cluster"]]["far"]
        return spreads / apart if apart else math.inf

    if df_between:
        bouldin = math.fsum(
            max(overlap(one, two) for two in clusters if two is not one) for one in clusters
        ) / len(clusters)
    silhouette = math.fsum(f["silhouette"] for f in fits.values()) / total
    return k, within, silhouette, ratio, bouldin


def sweep_k(
    base: DataFrame,
    ks: Sequence[int] = tuple(range(2, 9)),
    seed: int = SEED,
    features: Sequence[str] = FEATURES,
    with_indices: bool = True,
) -> DataFrame:
    """Bisecting k-means for every k: within-cluster squares and three indices.

    One row per k; every fit and every index is a distributed job over one
    materialised table. ``with_indices=False`` leaves the indices null.
    """
    spark = base.sparkSession
    vectors = materialise(_vectors(base, features))
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    rows = []
    for k in ks:
        model = BisectingKMeans(k=k, seed=seed).fit(vectors)
        row = [int(k), float(model.summary.trainingCost), None, None, None]
        if with_indices:
            found = model.transform(vectors)
            labelled = found.withColumn("cluster", F.col("prediction") + 1)
            indices = validity_indices(labelled, features).first()
            row[2:] = [
                float(silhouette.evaluate(found)),
                float(indices["calinski_harabasz"]),
                float(indices["davies_bouldin"]),
            ]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, _SWEEP_SCHEMA)


def choose_k(sweep: DataFrame) -> DataFrame:
    """Add to each k the number of indices that prefer it, and mark the winner.

    Silhouette and Calinski-Harabasz favour the largest value, Davies-Bouldin the
    smallest; the smaller k wins a tied vote.
    """
    favourite = sweep.agg(
        F.struct(
            F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette"),
            F.max_by("k", F.struct("calinski_harabasz", -F.col("k"))).alias("calinski_harabasz"),
            F.min_by("k", F.struct("davies_bouldin", "k")).alias("davies_bouldin"),
        )
    )
    votes = [
        (F.col("k") == F.col(f"_best.{name}")).cast("long")
        for name in ("silhouette", "calinski_harabasz", "davies_bouldin")
    ]
    voted = sweep.withColumn("_best", favourite.scalar()).withColumn(
        "votes", sum(votes[1:], votes[0])
    )
    winner = Window.orderBy(F.desc("votes"), "k")  # one row per k
    return voted.withColumn("best", F.row_number().over(winner) == 1).drop("_best")


def height_gain(sweep: DataFrame, last: int = 10) -> DataFrame:
    """Cost of each merge from k+1 to k clusters over the cost of all earlier ones.

    Merges run from many clusters to few; the last ones are returned.
    """
    by_k = Window.orderBy("k")  # one row per k
    merges = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sweep.select("k", (F.col("within_ss") - F.lead("within_ss").over(by_k)).alias("height"))
        .where("height IS NOT NULL")
        .withColumn(
            "gain",
            F.try_divide(F.col("height"), F.coalesce(F.sum("height").over(merges), F.lit(1.0))),
        )
        .orderBy("k")
        .limit(last)
    )
