"""Maximum likelihood by Newton steps, each from one aggregate over the data.

A job returns the log-likelihood with its first and second derivatives, summed in
the JVM with map-side combination: one row, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import bgnbd, gamma_gamma
from tillscope.functions.special import Derivatives
from tillscope.operators import fitting
from tillscope.operators.fitting import BGNBD_START, HIGHEST, LOWEST, SPEND_HIGHEST, SPEND_START
from tillscope.operators.lifetime import (
    bgnbd_log_likelihood,
    compress,
    repeat_buyers,
    spend_log_likelihood,
)
from tillscope.session import materialise

Slopes = Callable[[Mapping[str, Column]], Derivatives]

_NEAR = 1e-6
# A parameter this near the edge, in its logarithm, counts as on it.
_EDGE = 1e-3


def bgnbd_derivatives(params: Mapping[str, Column]) -> Derivatives:
    x, t_x, t_cal = (F.col(c).cast("double") for c in ("x", "t_x", "t_cal"))
    return bgnbd.derivatives(params, x, t_x, t_cal)


def spend_derivatives(params: Mapping[str, Column]) -> Derivatives:
    return gamma_gamma.derivatives(params, F.col("m_x"), F.col("x").cast("double"))


class Sums:
    """The sums of a model over parameter columns: expressions built once for all rounds."""

    def __init__(
        self,
        objective: fitting.Objective,
        derivatives: Slopes,
        names: Sequence[str],
        weight: str | None = None,
    ) -> None:
        columns = {name: F.col(f"_at_{name}") for name in names}
        self.steps, first, second = derivatives(columns)
        every = [objective(columns), *first, *[c for row in second for c in row]]
        totals = [F.sum(F.col(weight) * c if weight else c) for c in every]
        size = len(first)
        self.totals = [
            totals[0].alias("value"),
            F.array(*totals[1 : size + 1]).alias("score"),
            F.array(*totals[size + 1 :]).alias("bend"),
        ]

    def over(self, data: DataFrame, params: Mapping[str, float]) -> DataFrame:
        """One row: ``value``, the ``score`` vector and the upper triangle ``bend`` by rows."""
        data = data.withColumns({f"_at_{name}": F.lit(float(v)) for name, v in params.items()})
        for step in self.steps:
            data = data.withColumns(step)
        return data.agg(*self.totals)


def sums(
    data: DataFrame,
    objective: fitting.Objective,
    derivatives: Slopes,
    params: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """``Sums.over`` of the data at one set of parameters."""
    return Sums(objective, derivatives, list(params), weight).over(data, params)


def _climb(
    gradient: np.ndarray, hessian: np.ndarray, radius: float, below: np.ndarray, above: np.ndarray
) -> np.ndarray:
    """Newton step over the parameters that are not pushed out of the box.

    Directions that bend upwards are turned, so the step climbs; it is no longer
    than ``radius``.
    """
    free = ~((above & (gradient > 0)) | (below & (gradient < 0)))
    step = np.zeros(gradient.size)
    while free.any():
        bends, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
        bends = np.maximum(np.abs(bends), 1e-10 * max(1.0, np.abs(bends).max()))
        step = np.zeros(gradient.size)
        step[free] = axes @ ((axes.T @ gradient[free]) / bends)
        out = (above & (step > 0)) | (below & (step < 0))
        if not out.any():
            break
        free &= ~out
        step = np.zeros(gradient.size)
    length = np.linalg.norm(step)
    return step if length <= radius else step * (radius / length)


def fit(
    data: DataFrame,
    objective: fitting.Objective,
    derivatives: Slopes,
    start: Mapping[str, float],
    weight: str | None = None,
    rounds: int = 60,
    tolerance: float = 1e-10,
    highest: Mapping[str, float] | None = None,
) -> DataFrame:
    """Maximise a summed log-likelihood over positive parameters by Newton steps.

    Works on log parameters inside the box of ``fitting.fit`` and returns the same
    row. A step that does not climb is tried again at a quarter of its length; the
    fit has converged when a step gains less than ``tolerance`` relatively or
    promises that little. A parameter that ends on the edge is not identified.
    """
    names = list(start)
    low = np.full(len(names), math.log(LOWEST))
    high = np.log([(highest or {}).get(name, HIGHEST) for name in names])
    triangle = np.triu_indices(len(names))
    model = Sums(objective, derivatives, names, weight)

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        values = np.exp(point)
        row = model.over(data, dict(zip(names, values))).first()
        if row["value"] is None or None in row["score"] or None in row["bend"]:
            return None
        score = np.array(row["score"])
        bend = np.zeros((len(names), len(names)))
        bend[triangle] = row["bend"]
        bend = bend + np.triu(bend, 1).T
        # By the logarithms of the parameters.
        gradient = score * values
        hessian = bend * np.outer(values, values) + np.diag(gradient)
        if not (math.isfinite(row["value"]) and np.isfinite(gradient).all() and np.isfinite(hessian).all()):
            return None
        return row["value"], gradient, hessian

    best = np.clip(np.log([start[name] for name in names]), low, high)
    found, radius, converged, used = evaluate(best), 2.0, False, 1
    while found is not None and used < rounds:
        value, gradient, hessian = found
        step = _climb(gradient, hessian, radius, best <= low + _NEAR, best >= high - _NEAR)
        point = np.clip(best + step, low, high)
        step = point - best
        promised = gradient @ step + 0.5 * step @ hessian @ step
        if abs(promised) < 1e-3 * tolerance * max(1.0, abs(value)) or np.abs(step).max() < 1e-10:
            converged = True
            break
        tried = evaluate(point)
        used += 1
        if tried is None or tried[0] < value:
            radius = min(radius, float(np.linalg.norm(step))) / 4
            if tried is not None and value - tried[0] < tolerance * abs(value) and radius < 1e-5:
                converged = True  # rounding hides what is left to gain
                break
            if radius < 1e-9:
                break
            continue
        gained = tried[0] - value
        best, found, radius = point, tried, min(radius * 2, 4.0)
        if gained < tolerance * abs(tried[0]) and np.abs(step).max() < 1e-4:
            converged = True
            break
    edge = bool(np.any((best <= low + _EDGE) | (best >= high - _EDGE)))
    value = found[0] if found is not None else None
    row = (*[float(math.exp(v)) for v in best], value, edge, converged, used)
    schema = ", ".join([*[f"{name} double" for name in names], "log_likelihood double"])
    return data.sparkSession.createDataFrame(
        [row], f"{schema}, at_edge boolean, converged boolean, rounds_used int"
    )


def fit_bgnbd(history: DataFrame, start: Mapping[str, float] = BGNBD_START, **options) -> DataFrame:
    """BG/NBD parameters (r, alpha, a, b) from a purchase history."""
    data = materialise(compress(history))
    return fit(data, bgnbd_log_likelihood, bgnbd_derivatives, start, "weight", **options)


def fit_spend(history: DataFrame, start: Mapping[str, float] = SPEND_START, **options) -> DataFrame:
    """Gamma-Gamma parameters (p, q, gamma) from repeat buyers."""
    options.setdefault("highest", {"gamma": SPEND_HIGHEST})
    buyers = materialise(repeat_buyers(history).select("x", "m_x"))
    mean = buyers.agg(F.avg("m_x")).first()[0]
    if mean and start is SPEND_START:
        start = {**start, "gamma": mean * (start["q"] - 1) / start["p"]}
    return fit(buyers, spend_log_likelihood, spend_derivatives, start, **options)
