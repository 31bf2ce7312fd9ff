"""Agglomerative clusters over clustering features.

Plain agglomeration needs all pairwise distances. Here rows are summed up in
clustering features first (count, sums and scatter of the rows of a box), at most
``bound`` of them however many rows there are, and the features are merged. Where
every row is a feature of its own, this is the plain method.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.clustering import FEATURES
from tillscope.operators.ordering import row_index
from tillscope.session import materialise

# Halvings of the bounding box per column, and of the scatter allowed in a box.
LEVELS = 12
HALVINGS = 30
BOUND = 512


def _boxed(base: DataFrame, features: Sequence[str]) -> DataFrame:
    """``base`` with its place ``_q<i>`` on the finest grid and its offsets ``_x<i>``."""
    box = base.agg(
        F.struct(
            *[F.min(f).cast("double").alias(f"lo{i}") for i, f in enumerate(features)],
            *[F.max(f).cast("double").alias(f"hi{i}") for i, f in enumerate(features)],
        )
    )
    placed = base.withColumn("_box", box.scalar())
    for i, f in enumerate(features):
        low, high = F.col(f"_box.lo{i}"), F.col(f"_box.hi{i}")
        share = F.coalesce(F.try_divide(F.col(f) - low, high - low), F.lit(0.0))
        place = F.least(F.floor(share * (1 << LEVELS)).cast("long"), F.lit((1 << LEVELS) - 1))
        placed = placed.withColumns({f"_q{i}": place, f"_x{i}": F.col(f) - low})
    return placed.drop("_box")


def _cells(fine: DataFrame, width: int) -> DataFrame:
    """Boxes of all levels with ``scatter`` about their mean, and that of the box around."""
    numbers = range(width)
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    up = F.lit(LEVELS) - F.col("level")
    keys = [F.call_function("shiftright", F.col(f"_q{i}"), up).alias(f"_p{i}") for i in numbers]
    sums = [f"{kind}{i}" for kind in ("s", "q") for i in numbers]
    cells = (
        fine.select("*", level)
        .groupBy("level", *keys)
        .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    )
    spread = sum(
        (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n") for i in numbers), F.lit(0.0)
    )
    # A box of the finest grid counts as a point.
    point = (F.col("n") == 1) | (F.col("level") == LEVELS)
    cells = materialise(
        cells.withColumn("scatter", F.when(point, 0.0).otherwise(F.greatest(spread, F.lit(0.0))))
    )
    around = cells.select(
        (F.col("level") + 1).alias("_level"),
        *[F.col(f"_p{i}").alias(f"_up{i}") for i in numbers],
        F.col("scatter").alias("around"),
    )
    on = F.col("level") == F.col("_level")
    for i in numbers:
        on = on & (F.shiftright(f"_p{i}", 1) == F.col(f"_up{i}"))
    return cells.join(around, on, "left")


def clustering_features(
    base: DataFrame, bound: int = BOUND, features: Sequence[str] = FEATURES
) -> DataFrame:
    """At most ``bound`` features ``(feature, level, place, n, mean, scatter)`` of ``base``.

    The bounding box is halved along every column. A feature is the largest box
    whose scatter is at most the total scatter over a power of two, the smallest
    such share that gives no more than ``bound`` boxes; all boxes of the finest
    grid if they are as few. ``place`` are the box numbers on its level, ``mean``
    the means of the columns. Two aggregations with map-side sums, whose result
    does not depend on how rows are partitioned. An empty table has no features; a
    row with a null or infinite value raises.
    """
    if bound < 1:
        raise ValueError("bound must be 1 or more")
    width, numbers = len(features), range(len(features))
    finite = [F.coalesce(F.abs(F.col(f)) < float("inf"), F.lit(False)) for f in features]
    if base.select(F.every(reduce(and_, finite))).first()[0] is False:
        raise ValueError("features must be finite numbers")
    fine = _boxed(base, features).groupBy(*[f"_q{i}" for i in numbers]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"_x{i}").alias(f"s{i}") for i in numbers],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{i}")).alias(f"q{i}") for i in numbers],
    )
    cells = materialise(_cells(materialise(fine), width))
    total = F.lit(cells.agg(F.max("scatter")).first()[0] or 0.0)
    allowed = [total / float(1 << i) for i in range(HALVINGS + 1)]

    def is_leaf(limit: Column) -> Column:
        outside = F.coalesce(F.col("around"), F.lit(float("inf"))) > limit
        return (F.col("scatter") <= limit) & outside

    counts = cells.agg(
        F.count_if(F.col("level") == LEVELS),
        *[F.count_if(is_leaf(limit)) for limit in allowed],
    ).first()
    if counts[0] <= bound:
        chosen = F.col("level") == LEVELS
    else:
        chosen = is_leaf(allowed[max(i for i, n in enumerate(counts[1:]) if n <= bound)])
    low = base.agg(F.array(*[F.min(f).cast("double") for f in features]))
    leaves = cells.where(chosen).withColumn("_low", low.scalar())
    found = leaves.select(
        "level",
        F.array(*[F.col(f"_p{i}") for i in numbers]).alias("place"),
        "n",
        F.array(
            *[F.col("_low")[i] + F.col(f"s{i}") / F.col("n") for i in numbers]
        ).alias("mean"),
        "scatter",
    )
    return row_index(found, ["mean", "level", "place"], "feature")


def merge_features(
    weights: np.ndarray, means: np.ndarray, power: int = 1
) -> list[tuple[int, int, float, int]]:
    """Ward merges ``(left, right, height, rows)`` of weighted points, cheapest first.

    Points are nodes 1, 2, ..., the n-th merge of m points is node m + n; a tie goes
    to the pair with the least nodes. Distances follow the Lance-Williams recursion
    from Euclidean distances (``power`` 1) or their squares (2, where a height is
    twice the growth of the scatter). Points of some weight start as if that many
    equal points had been merged.
    """
    m = len(weights)
    sizes = np.asarray(weights, float).copy()
    gaps = ((means[:, None, :] - means[None, :, :]) ** 2).sum(axis=2)
    distance = gaps if power == 2 else np.sqrt(gaps)
    distance = distance * 2 * sizes[:, None] * sizes[None, :] / (sizes[:, None] + sizes[None, :])
    distance[np.tril_indices(m)] = np.inf
    node, merges = np.arange(1, m + 1), []
    for step in range(1, m):
        cheapest = distance.min()
        rows, columns = np.nonzero(distance == cheapest)
        pairs = sorted(
            (*sorted((int(node[i]), int(node[j]))), int(i), int(j)) for i, j in zip(rows, columns)
        )
        left, right, i, j = pairs[0]
        full = np.minimum(distance, distance.T)
        others = sizes * (node > 0)
        merged = (
            (sizes[i] + others) * full[i] + (sizes[j] + others) * full[j] - others * cheapest
        ) / (sizes[i] + sizes[j] + others)
        sizes[i] += sizes[j]
        merges.append((left, right, float(cheapest), int(sizes[i])))
        node[i], node[j] = m + step, 0
        merged[(node == 0) | (np.arange(m) == i)] = np.inf
        distance[i, i + 1 :] = merged[i + 1 :]
        distance[:i, i] = merged[:i]
        distance[j, :] = distance[:, j] = np.inf
    return merges


_TREE = "step long, left long, right long, height double, customers long, clusters long"


def merge_tree(features: DataFrame, power: int = 1) -> DataFrame:
    """Merge tree of ``clustering_features``: one row per merge, heights rising.

    Reads the features, at most their bound, to the driver. ``clusters`` is the
    number of clusters after the merge; see ``merge_features`` for the rest.
    """
    rows = features.select("feature", "n", "mean").orderBy("feature").collect()
    if not rows:
        return features.sparkSession.createDataFrame([], _TREE)
    merges = merge_features(
        np.array([r["n"] for r in rows]), np.array([r["mean"] for r in rows], float), power
    )
    table = [(n, *merge, len(rows) - n) for n, merge in enumerate(merges, start=1)]
    return features.sparkSession.createDataFrame(table, _TREE)


def cut_tree(tree: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """``features`` with their ``cluster`` among ``k``, numbered by the least feature in it."""
    count = features.count()  # bounded, like the tree
    parent = list(range(2 * count))
    for row in tree.where(F.col("clusters") >= k).collect():
        parent[row["left"]] = parent[row["right"]] = count + row["step"]
    number, labels = {}, []
    for feature in range(1, count + 1):
        root = feature
        while parent[root] != root:
            root = parent[root]
        labels.append((feature, number.setdefault(root, len(number) + 1)))
    found = features.sparkSession.createDataFrame(labels, "feature long, cluster long")
    return features.join(F.broadcast(found), "feature")  # one row per feature


def label_rows(base: DataFrame, labelled: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``base`` with the ``cluster`` of the feature each row was summed up in.

    Rows find their box on each level that has features: one pass with broadcasts
    of at most the bound of the features.
    """
    placed = _boxed(base, features)
    found = F.lit(None).cast("long")
    for row in labelled.select("level").distinct().orderBy("level").collect():
        level = row["level"]
        boxes = labelled.where(F.col("level") == level).select(
            *[F.col("place")[i].alias(f"_b{level}_{i}") for i in range(len(features))],
            F.col("cluster").alias(f"_c{level}"),
        )
        on = F.lit(True)
        for i in range(len(features)):
            on = on & (F.shiftright(f"_q{i}", LEVELS - level) == F.col(f"_b{level}_{i}"))
        placed = placed.join(F.broadcast(boxes), on, "left")
        found = F.coalesce(found, F.col(f"_c{level}"))
    return placed.select(*base.columns, found.alias("cluster"))


def ward_clusters(
    base: DataFrame,
    k: int = 4,
    bound: int = BOUND,
    power: int = 1,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """``base`` with the cluster of each row from Ward merges of its clustering features."""
    data = materialise(base)
    summed = materialise(clustering_features(data, bound, features))
    return label_rows(data, cut_tree(merge_tree(summed, power), summed, k), features)


def merge_gain(tree: DataFrame, last: int = 10) -> DataFrame:
    """Height of the last merges over the sum of all earlier heights (over 1 for the first).

    The tree is bounded by its features, so one window over it is small.
    """
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gained = tree.withColumn(
        "gain", F.try_divide("height", F.coalesce(F.sum("height").over(before), F.lit(1.0)))
    )
    return gained.where(F.col("clusters") <= last).select("step", "clusters", "height", "gain")
