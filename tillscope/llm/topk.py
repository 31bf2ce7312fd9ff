"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Queries and candidates are dealt into blocks;
for a pair of blocks, each term of a query row scatters its weighted postings into
a dense array of scores, the best k are selected by partition, and the lists of
all candidate blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import materialise, ship_package

# Fixed value: components are taken in steps of 1/256.
SCALE = 256.0


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(rid, vec_id, weights)``: floor(256 * x) of every component, materialised.

    Vectors that are null or hold a null or non-finite component are left out.
    ``rid`` tells rows with the same id apart.
    """
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull()
        & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < float("inf")),
    )
    weights = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    return materialise(
        vectors.where(F.col("embedding").isNotNull() & finite).select(
            F.monotonically_increasing_id().alias("rid"),
            F.col("vec_id").cast("long"),
            weights.alias("weights"),
        )
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def block_top(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> Iterator[tuple]:
    """``(query rid, query id, candidate id, score)`` of the best k in one block pair."""
    width = max([0, *map(len, queries["weights"]), *map(len, candidates["weights"])])
    terms = np.ascontiguousarray(_matrix(candidates["weights"], width).T)
    postings = []
    for column in terms:
        at = np.flatnonzero(column)
        postings.append((slice(None) if len(at) == len(column) else at, column[at]))
    weights = _matrix(queries["weights"], width)
    null = candidates["vec_id"].isna().to_numpy()
    ids = candidates["vec_id"].fillna(0).to_numpy(np.int64)
    place = {rid: n for n, rid in enumerate(candidates["rid"])}
    for row, rid, query_id in zip(weights, queries["rid"], queries["vec_id"]):
        scores = np.zeros(len(ids), np.int64)
        for term in np.flatnonzero(row):
            where, weight = postings[term]
            scores[where] += row[term] * weight
        others = np.ones(len(ids), bool)
        if rid in place:
            others[place[rid]] = False
        left = np.flatnonzero(others)
        if len(left) > k:
            own = scores[left]
            left = left[own >= np.partition(own, len(own) - k)[len(own) - k]]
        best = left[np.lexsort((ids[left], null[left], -scores[left]))][:k]
        for n in best:
            yield rid, int(query_id), None if null[n] else int(ids[n]), int(scores[n])


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    query_rows: int = 4096,
    candidate_rows: int = 8192,
) -> DataFrame:
    """The ``k`` highest inner products of each query row with all other rows.

    Queries are the rows whose ``vec_id`` is divisible by ``every``. Returns
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller
    vec_id, a null id comes last. A row with a query's id but another row is a
    candidate like any other; repeated query rows each get their own ranks.
    Missing trailing components count as 0; sums are 64-bit. Fewer than ``k``
    other rows give them all, an empty table none.

    Block sizes are fixed, so a task holds one block of each side whatever the
    tables' size; rows are dealt by row and not by id, so copies are spread evenly.
    """
    ship_package(vectors.sparkSession)
    rows = integer_vectors(vectors)
    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_candidates = max(1, math.ceil(rows.count() / candidate_rows))
    n_queries = max(1, math.ceil(wanted.count() / query_rows))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = list(block_top(queries, candidates, k)) if len(queries) and len(candidates) else []
        return pd.DataFrame(found, columns=["rid", "query_id", "vec_id", "score"]).astype(
            {"rid": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"}
        )

    blocks = ["q_block", "c_block"]
    lists = (
        dealt(wanted, "q_block", n_queries, "c_block", n_candidates)
        .groupBy(*blocks)
        .cogroup(dealt(rows, "c_block", n_candidates, "q_block", n_queries).groupBy(*blocks))
        .applyInPandas(run, "rid long, query_id long, vec_id long, score long")
    )
    merged = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        lists.withColumn("rank", F.row_number().over(merged).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
