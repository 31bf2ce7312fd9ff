"""Maximum likelihood by scoring many candidates in one Spark job."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import pnbd
from tillscope.operators.lifetime import (
    bgnbd_log_likelihood,
    compress,
    pnbd_log_likelihood,
    repeat_buyers,
    spend_log_likelihood,
)
from tillscope.session import materialise, ship_package

Objective = Callable[[Mapping[str, Column]], Column]

# Where the search starts (the spend scale follows the data), and the box that
# holds every parameter.
BGNBD_START = {"r": 1.0, "alpha": 10.0, "a": 0.5, "b": 3.0}
PNBD_START = {"r": 1.0, "alpha": 10.0, "s": 0.5, "beta": 10.0}
SPEND_START = {"p": 2.0, "q": 4.0, "gamma": 100.0}
LOWEST, HIGHEST = 1e-4, 1e4
_REACHES = (2.0, 4.0, 8.0)
_NEAR = 1e-6
SPEND_HIGHEST = 1e9  # gamma carries the unit of money

# Rows of a fit behind one task, and those that a task scores at a time.
_ROWS_PER_TASK, _ROWS_AT_ONCE = 1_000_000, 200_000


def _candidate_table(candidates: Sequence[Mapping[str, float]]) -> Column:
    """The candidates as a constant array, written as one SQL literal."""
    rows = (
        ", ".join([f"{i} AS candidate", *[f"{float(v)!r}D AS _{k}" for k, v in c.items()]])
        for i, c in enumerate(candidates)
    )
    return F.expr("array(" + ", ".join(f"struct({row})" for row in rows) + ")")


def weighted(objective: Objective, names: Sequence[str], weight: str | None) -> Column:
    """The objective over the parameter columns of a candidate, times the weight."""
    value = objective({name: F.col(f"_{name}") for name in names})
    return F.col(weight) * value if weight else value


def score_candidates(
    data: DataFrame, candidates: Sequence[Mapping[str, float]], value: Column
) -> DataFrame:
    """Log-likelihood of every candidate as ``(candidate, log_likelihood)``.

    ``value`` comes from ``weighted``. The candidates are a constant array spread
    over each row, so one scan scores them all, and only one partial sum per task
    and candidate is shuffled.
    """
    return (
        data.select("*", F.inline(_candidate_table(candidates)))
        .select("candidate", value.alias("_value"))
        .groupBy("candidate")
        .agg(F.sum("_value").alias("log_likelihood"))
    )


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow batches put together to about ``_ROWS_AT_ONCE`` rows."""
    held, rows = [], 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= _ROWS_AT_ONCE:
            yield pd.concat(held)
            held, rows = [], 0
    if rows:
        yield pd.concat(held)


def score_pnbd(data: DataFrame, candidates: Sequence[Mapping[str, float]]) -> DataFrame:
    """``score_candidates`` of the Pareto/NBD log-likelihood over compressed histories.

    A task takes the drop-out integrals once for every distinct (x, time) among its rows, so
    that their number is bounded by the calendar and not by the number of histories.
    """
    ship_package(data.sparkSession)
    points = [tuple(float(c[name]) for name in pnbd.PARAMETERS) for c in candidates]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(frames):
            x, t_x, t_cal, weight = chunk.to_numpy(dtype=float).T
            rows = pnbd.Histories(x, t_x, t_cal)
            with np.errstate(all="ignore"):
                sums = [float(weight @ rows.log_likelihoods(*point)) for point in points]
            yield pd.DataFrame({"candidate": range(len(points)), "value": sums})

    names = ("x", "t_x", "t_cal", "weight")
    known = data.select(*[F.col(name).cast("double") for name in names]).where(
        " AND ".join(f"{name} IS NOT NULL" for name in names)
    )
    return (
        known.mapInPandas(score, "candidate int, value double")
        .groupBy("candidate")
        .agg(F.sum("value").alias("log_likelihood"))
    )


def _stencil(center: np.ndarray, step: float) -> list[np.ndarray]:
    """Centre, two points per axis and two per pair of axes: fits a quadratic."""
    axes = np.eye(center.size) * step
    moves = list(axes)
    moves += [axes[i] + axes[j] for i in range(center.size) for j in range(i + 1, center.size)]
    return [center, *[center + sign * move for move in moves for sign in (1, -1)]]


def _quadratic_move(
    values: np.ndarray, step: float, radius: float, below: np.ndarray, above: np.ndarray
) -> np.ndarray | None:
    """Ascent step from the stencil's quadratic, no longer than ``radius``.

    ``below`` and ``above`` mark parameters on the edge of the box; those that the
    gradient would push out stay where they are.
    """
    size = below.size
    up, down = values[1 : 2 * size + 1 : 2], values[2 : 2 * size + 1 : 2]
    gradient = (up - down) / (2 * step)
    bend = up + down - 2 * values[0]
    hessian = np.diag(bend / step**2)
    at = 2 * size + 1
    for i in range(size):
        for j in range(i + 1, size):
            both = values[at] + values[at + 1] - 2 * values[0]
            hessian[i, j] = hessian[j, i] = (both - bend[i] - bend[j]) / (2 * step**2)
            at += 2
    if not (np.isfinite(gradient).all() and np.isfinite(hessian).all()):
        return None
    free = ~((above & (gradient > 0)) | (below & (gradient < 0)))
    move = np.zeros(size)
    while free.any():
        # Curvature bent to point downwards, so the move always climbs.
        curvature, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
        bent = np.maximum(np.abs(curvature), 1e-8 * max(1.0, np.abs(curvature).max()))
        move = np.zeros(size)
        move[free] = axes @ ((axes.T @ gradient[free]) / bent)
        leaving = (above & (move > 0)) | (below & (move < 0))
        if not leaving.any():
            break
        free &= ~leaving
        move = np.zeros(size)
    length = np.linalg.norm(move)
    return move if length <= radius else move * (radius / length)


def _inside(base: np.ndarray, move: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``base + move``, the move shortened as a whole where it would leave the box."""
    room = np.where(move > 0, high - base, base - low)
    share = np.min(np.where(move != 0, room / np.maximum(np.abs(move), 1e-300), 1.0), initial=1.0)
    return base + move * max(0.0, share)


def fit(
    data: DataFrame,
    objective: Objective,
    start: Mapping[str, float],
    weight: str | None = "weight",
    rounds: int = 40,
    step: float = 0.01,
    radius: float = 1.0,
    tolerance: float = 1e-9,
    highest: Mapping[str, float] | None = None,
    score: Callable[[DataFrame, Sequence[Mapping[str, float]]], DataFrame] | None = None,
) -> DataFrame:
    """Maximise a summed log-likelihood over positive parameters.

    Works on log parameters inside a box. Each round scores a fixed set of about
    20 candidates around the proposed point in one job, and the driver sees one
    number per candidate. The next proposal is the top of the quadratic through
    them, within a radius that grows on success and shrinks on failure. Ends when
    a round gains less than ``tolerance`` relatively, or after ``rounds`` rounds. A
    parameter that ends on the edge of the box is not identified by the data.

    Returns one row: the parameters, ``log_likelihood``, ``at_edge``, ``converged``
    and ``rounds_used``. It has converged if a round gained less than the tolerance,
    or if no better point was found within 1e-6 of the best; running out of rounds
    is no convergence. ``score`` may replace ``score_candidates`` where the same sums
    are found at less cost.
    """
    names = list(start)
    size = len(names)
    low = np.full(size, math.log(LOWEST))
    high = np.log([(highest or {}).get(name, HIGHEST) for name in names])
    value = weighted(objective, names, weight)

    def evaluate(points: Sequence[np.ndarray]) -> np.ndarray:
        candidates = [dict(zip(names, np.exp(p), strict=True)) for p in points]
        found = np.full(len(points), -np.inf)
        scored = score(data, candidates) if score else score_candidates(data, candidates, value)
        for row in scored.collect():
            total = row["log_likelihood"]
            if total is not None and math.isfinite(total):
                found[row["candidate"]] = total
        return found

    # Centres keep a distance from the edge, so that the stencil stays inside.
    low, high = low + step, high - step
    center = np.clip(np.log([start[name] for name in names]), low, high)
    best, best_value = center, -math.inf
    base, base_values, move = center, None, None
    converged, used = False, 0
    for used in range(1, rounds + 1):
        points = _stencil(center, step)
        measured = len(points)
        if move is not None:
            # A bent valley rewards a longer move: try a few in the same job.
            points += [_inside(base, move * reach, low, high) for reach in _REACHES]
        values = evaluate(points)
        top = int(np.argmax(values))
        gained = values[top] - best_value
        if gained > 0:
            best, best_value = points[top], float(values[top])
            radius = min(radius * 1.5, 3.0)
            if gained < tolerance * abs(best_value):
                converged = True
                break
            if top >= measured:
                center, move = best, None
                continue
            base, base_values = center, values[:measured]
        else:
            radius /= 4
            if radius < 1e-6 or base_values is None:
                converged = base_values is not None
                break
        move = _quadratic_move(
            base_values, step, radius, base <= low + _NEAR, base >= high - _NEAR
        )
        if move is None:
            # Unbounded somewhere on the stencil: go to its best point instead.
            center = np.clip(best, low, high)
        else:
            center = _inside(base, move, low, high)
    edge = bool(np.any((best <= low + _NEAR) | (best >= high - _NEAR)))
    row = (*[float(math.exp(v)) for v in best], best_value, edge, converged, used)
    schema = ", ".join([*[f"{name} double" for name in names], "log_likelihood double"])
    return data.sparkSession.createDataFrame(
        [row], f"{schema}, at_edge boolean, converged boolean, rounds_used int"
    )


_REPORTED = ("log_likelihood", "at_edge", "converged", "rounds_used")


def parameters(fitted: DataFrame, allow_unfinished: bool = False) -> dict[str, float]:
    """The parameters of a one-row fit as plain numbers.

    Raises if the fit has not converged, unless ``allow_unfinished``.
    """
    row = fitted.first().asDict()
    if not row["converged"] and not allow_unfinished:
        raise ArithmeticError(f"the fit has not converged after {row['rounds_used']} rounds")
    return {k: float(v) for k, v in row.items() if k not in _REPORTED}


def _spread(data: DataFrame) -> DataFrame:
    """Materialise evenly over all cores: few bytes per row, but much arithmetic.

    The cores are counted after a first job, when the executors are there.
    """
    found = materialise(data)
    cores = found.sparkSession.sparkContext.defaultParallelism
    return materialise(found.repartition(max(cores, found.count() // _ROWS_PER_TASK + 1)))


def fit_bgnbd(history: DataFrame, start: Mapping[str, float] = BGNBD_START, **options) -> DataFrame:
    """BG/NBD parameters (r, alpha, a, b) from a purchase history."""
    return fit(_spread(compress(history)), bgnbd_log_likelihood, start, **options)


def fit_pnbd(history: DataFrame, start: Mapping[str, float] = PNBD_START, **options) -> DataFrame:
    """Pareto/NBD parameters (r, alpha, s, beta) from a purchase history."""
    if options.get("weight", "weight") == "weight":
        options.setdefault("score", score_pnbd)
    return fit(_spread(compress(history)), pnbd_log_likelihood, start, **options)


def fit_spend(history: DataFrame, start: Mapping[str, float] = SPEND_START, **options) -> DataFrame:
    """Gamma-Gamma parameters (p, q, gamma) from repeat buyers."""
    options.setdefault("highest", {"gamma": SPEND_HIGHEST})
    buyers = _spread(repeat_buyers(history).select("x", "m_x"))
    mean = buyers.agg(F.avg("m_x")).first()[0]
    if mean and start is SPEND_START:
        start = {**start, "gamma": mean * (start["q"] - 1) / start["p"]}
    return fit(buyers, spend_log_likelihood, start, weight=None, **options)
