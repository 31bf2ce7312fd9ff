"""A second linkage, the gap statistic and p-values for customer clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.special import log_f_tail
from tillscope.operators.clustering import FEATURES, anova
from tillscope.operators.ordering import top_k
from tillscope.session import materialise

# A prime and multipliers that spread ids over its residues.
_PRIME = 2_147_483_647
_BY_ID = (48_271, 69_621, 16_807, 39_373, 62_089, 742_938)
_BY_DRAW = 1_226_874


def _gap(features: Sequence[str], center: Sequence[float]) -> Column:
    terms = [F.pow(F.col(f) - F.lit(float(c)), 2) for f, c in zip(features, center)]
    return F.sqrt(sum(terms[1:], terms[0]))


def farthest_first(
    base: DataFrame, k: int = 4, key: str = "customer_id", features: Sequence[str] = FEATURES
) -> DataFrame:
    """Complete-linkage companion: ``base`` with ``cluster`` and ``distance`` to its centre.

    Centres are rows: first the one farthest from the column means, then always the
    one farthest from all centres so far; ties go to the smaller key. The largest
    distance is at most twice the smallest that any k centres allow. One job a
    round, which returns one row; a row joins its first nearest centre. Fewer
    distinct rows than k give fewer clusters, an empty table none.
    """
    data = materialise(base)
    means = data.agg(*[F.avg(f).cast("double").alias(f) for f in features]).first()
    if means[0] is None:
        return data.withColumns(
            {"cluster": F.lit(1).cast("long"), "distance": F.lit(0.0)}
        ).limit(0)
    centers: list[Sequence[float]] = []
    reach = _gap(features, means)
    while len(centers) < k:
        far = top_k(data.withColumn("_reach", reach), 1, "_reach", key).first()
        if centers and far["_reach"] == 0:
            break
        centers.append([far[f] for f in features])
        reach = F.least(*gaps) if len(gaps := [_gap(features, c) for c in centers]) > 1 else gaps[0]
    label = F.lit(len(centers))
    for i in range(len(centers) - 1, 0, -1):
        label = F.when(_gap(features, centers[i - 1]) == reach, F.lit(i)).otherwise(label)
    return data.withColumns({"cluster": label.cast("long"), "distance": reach})


def linkage_radii(labelled: DataFrame) -> DataFrame:
    """Customers, largest and mean distance to the centre per cluster of ``farthest_first``."""
    return labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        F.max("distance").alias("radius"),
        F.avg("distance").alias("mean_distance"),
    )


def _uniform(number: Column, draw: Column, at: int) -> Column:
    """A number in [0, 1) from a row's number, a draw and a column, the same everywhere.

    Integer arithmetic below 2^62: a cube of a multiple, modulo a prime.
    """
    mixed = (F.pmod(number, F.lit(_PRIME)) * _BY_ID[at] + (draw + 1) * (_BY_DRAW + at)) % _PRIME
    mixed = (mixed * mixed % _PRIME) * mixed % _PRIME
    return mixed / F.lit(float(_PRIME))


def gap_statistic(
    base: DataFrame,
    ks: Sequence[int] = tuple(range(1, 7)),
    draws: int = 4,
    rounds: int = 3,
    number: Column | None = None,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Gap statistic of ``base`` for every k, by clusters of the data and of uniform draws.

    Each draw has as many rows as the data, uniform over its bounding box, from a
    hash of ``number`` (a long per row; by default a hash of the features). Data and
    draws are clustered together: fixed Lloyd rounds from centres spread along the
    diagonal of each table's box, all k of a round in one job with a row per
    cluster. Returns k, ``log_within`` (of the squares within clusters), ``expected``
    (its mean over the draws), ``gap``, ``spread`` (its standard error) and ``best``
    for the first k whose gap is not below the next one's less its spread; without
    one, the last k. Squares of zero give null logarithms. An empty table has no rows.
    """
    if len(features) > len(_BY_ID) or draws < 1 or not ks:
        raise ValueError("too many features, or no draws or numbers of clusters")
    number = F.xxhash64(*features) if number is None else number
    data = materialise(base.select(number.cast("long").alias("_number"), *features))
    box = data.agg(
        *[F.min(f).cast("double").alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(f).cast("double").alias(f"hi{i}") for i, f in enumerate(features)],
    ).first()
    schema = "k long, log_within double, expected double, gap double, spread double, best boolean"
    if box[0] is None:
        return base.sparkSession.createDataFrame([], schema)
    table = data.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(draws)).cast("array<bigint>")).alias("_draw")
    )
    drawn = [
        F.when(F.col("_draw") == 0, F.col(f).cast("double"))
        .otherwise(
            F.lit(box[f"lo{i}"])
            + F.lit(box[f"hi{i}"] - box[f"lo{i}"]) * _uniform(F.col("_number"), F.col("_draw"), i)
        )
        .alias(f"_x{i}")
        for i, f in enumerate(features)
    ]
    points = materialise(table.select("_draw", *drawn))
    columns = [f"_x{i}" for i in range(len(features))]
    boxes = points.groupBy("_draw").agg(
        F.array(*[F.min(c) for c in columns]).alias("lo"),
        F.array(*[F.max(c) for c in columns]).alias("hi"),
    ).collect()  # one row per draw
    centers = {
        (row["_draw"], k, n): [
            lo + (2 * n - 1) / (2.0 * k) * (hi - lo) for lo, hi in zip(row["lo"], row["hi"])
        ]
        for row in boxes
        for k in ks
        for n in range(1, k + 1)
    }

    def assigned() -> DataFrame:
        """Every point once per k with its nearest centre; centres are draws x sum of k rows."""
        rows = [
            (draw, k, [centers[draw, k, n] for n in range(1, k + 1)])
            for draw in sorted({key[0] for key in centers})
            for k in ks
        ]
        placed = points.join(
            F.broadcast(
                base.sparkSession.createDataFrame(
                    rows, "_of long, k long, _centers array<array<double>>"
                )
            ),
            F.col("_draw") == F.col("_of"),
        )

        def squares(center: Column) -> Column:
            terms = [F.pow(F.col(c) - center[i], 2) for i, c in enumerate(columns)]
            return sum(terms[1:], terms[0])

        placed = placed.withColumn("_squares", F.transform("_centers", squares))
        least = F.array_min("_squares")
        return placed.select(
            "_draw", "k", *columns, least.alias("_least"),
            F.array_position("_squares", least).alias("_cluster"),
        )

    for _ in range(rounds):
        found = assigned().groupBy("_draw", "k", "_cluster").agg(*[F.avg(c).alias(c) for c in columns])
        for row in found.collect():
            centers[row["_draw"], row["k"], row["_cluster"]] = [row[c] for c in columns]
    within = {
        (row["_draw"], row["k"]): row["w"]
        for row in assigned().groupBy("_draw", "k").agg(F.sum("_least").alias("w")).collect()
    }
    rows = []
    for k in ks:
        logs = [
            math.log(within[d, k]) if within[d, k] > 0 else None for d in range(draws + 1)
        ]
        if None in logs:
            rows.append([k, logs[0], None, None, None])
            continue
        mean = sum(logs[1:]) / draws
        spread = math.sqrt(sum((v - mean) ** 2 for v in logs[1:]) / draws) * math.sqrt(1 + 1 / draws)
        rows.append([k, logs[0], mean, mean - logs[0], spread])
    best = next(
        (
            a[0]
            for a, b in zip(rows, rows[1:])
            if None not in (a[3], b[3]) and a[3] >= b[3] - b[4]
        ),
        rows[-1][0],
    )
    return base.sparkSession.createDataFrame([(*row, row[0] == best) for row in rows], schema)


def anova_with_p(labelled: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The analysis of variance with ``p_value`` and ``log10_p`` of each F.

    The logarithm keeps its size where the value itself is too small for a double.
    One cluster, or no spread within clusters, gives null.
    """
    tail = log_f_tail(F.col("f_value"), F.col("df_between"), F.col("df_within"))
    table = anova(labelled, features).withColumn("_tail", tail)
    return table.withColumns(
        {"p_value": F.exp("_tail"), "log10_p": F.col("_tail") / math.log(10)}
    ).drop("_tail")


def significance_stars(p_value: Column) -> Column:
    """The usual marks: three stars below 0.001, two below 0.01, one below 0.05, a dot below 0.1."""
    return (
        F.when(p_value.isNull(), F.lit(None).cast("string"))
        .when(p_value < 0.001, "***")
        .when(p_value < 0.01, "**")
        .when(p_value < 0.05, "*")
        .when(p_value < 0.1, ".")
        .otherwise("")
    )
