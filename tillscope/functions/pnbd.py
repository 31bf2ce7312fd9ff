"""Pareto/NBD purchase model (Schmittlein, Morrison & Colombo 1987).

The closed forms follow Fader & Hardie 2005; ``params`` maps r, alpha, s, beta to
columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.functions.special import (
    hyp2f1,
    let,
    log_add,
    log_gamma,
    log_power_integral,
    log_power_integrals,
    log_rising,
)

PARAMETERS = ("r", "alpha", "s", "beta")


def _log_dropout(params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column) -> Column:
    """ln of s/(r+s+x) A0, the paths that dropped out after t_x; null where t_x = t_cal.

    As the integral over the drop-out time of which A0 is the closed form: it needs neither a
    series whose length depends on the row nor the difference of two of them.
    """
    r, alpha, s, beta = (params[name] for name in PARAMETERS)
    return F.log(s) + log_power_integral(alpha, beta, r + x, s + 1, t_x, t_cal)


def log_likelihood(params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column) -> Column:
    r, alpha, s, beta = (params[name] for name in PARAMETERS)
    alive = -(r + x) * F.log(alpha + t_cal) - s * F.log(beta + t_cal)
    return (
        log_rising(r, x)
        + r * F.log(alpha)
        + s * F.log(beta)
        + let(_log_dropout(params, x, t_x, t_cal), lambda gone: log_add(alive, gone))
    )


class Histories:
    """Rows (x, t_x, t_cal) for repeated likelihoods, with each distinct (x, time) kept once.

    The paths that dropped out between t_x and t_cal are those that did so between t_x and the
    last t_cal of all rows, less those between t_cal and then. So only one integral is needed for
    a distinct (x, t_x) or (x, t_cal), of which a calendar has few. The part that is taken away is
    never more than the paths alive at t_cal, so the sum keeps its digits.
    """

    def __init__(self, x: np.ndarray, t_x: np.ndarray, t_cal: np.ndarray):
        n = x.size
        self.end = t_cal.max()
        both = np.stack([np.concatenate([x, x]), np.concatenate([t_x, t_cal])], axis=1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        ordered = both[order]
        new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
        place = np.empty(2 * n, dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        self.x, self.t = ordered[new].T
        self.first, self.last = place[:n], place[n:]
        self.some = t_cal > t_x
        self.counts, self.count = np.unique(x, return_inverse=True)

    def log_likelihoods(self, r: float, alpha: float, s: float, beta: float) -> np.ndarray:
        """The values of ``log_likelihood`` for these rows."""
        gone = math.log(s) + log_power_integrals(alpha, beta, r + self.x, s + 1, self.t, self.end)
        alive = -(r + self.x) * np.log(alpha + self.t) - s * np.log(beta + self.t)
        rising = np.array([math.lgamma(r + k) for k in self.counts]) - math.lgamma(r)
        early, late, alive = gone[self.first], gone[self.last], alive[self.last]
        high = np.maximum(early, alive)
        both = np.exp(alive - high) + np.exp(early - high) - np.exp(late - high)
        paths = np.where(self.some, high + np.log(both), alive)
        return rising[self.count] + r * math.log(alpha) + s * math.log(beta) + paths


def p_alive(params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column) -> Column:
    r, alpha, s, beta = (params[name] for name in PARAMETERS)
    log_odds = (
        _log_dropout(params, x, t_x, t_cal)
        + (r + x) * F.log(alpha + t_cal)
        + s * F.log(beta + t_cal)
    )
    return 1 / (1 + F.coalesce(F.exp(log_odds), F.lit(0.0)))


def expected_purchases(
    params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column, horizon: Column
) -> Column:
    """Purchases expected in the next ``horizon`` weeks given the history."""
    r, alpha, s, beta = (params[name] for name in PARAMETERS)
    rate = (r + x) * (beta + t_cal) / (alpha + t_cal)
    shrink = F.log((beta + t_cal) / (beta + t_cal + horizon))
    # (1 - exp((s - 1) shrink)) / (s - 1), and its limit at s = 1.
    fade = F.when(F.abs(s - 1) < 1e-9, -shrink).otherwise(
        F.try_divide(-F.expm1((s - 1) * shrink), s - 1)
    )
    return p_alive(params, x, t_x, t_cal) * rate * fade


def pmf(params: Mapping[str, Column], k: int, t_cal: Column) -> Column:
    """Probability of exactly k repeat purchases in ``t_cal`` weeks.

    Meant for one row per distinct ``t_cal``: each call sums k + 2 series.
    """
    r, alpha, s, beta = (params[name] for name in PARAMETERS)
    miss, hit = alpha / (alpha + t_cal), t_cal / (alpha + t_cal)
    stay = F.pow(miss, r) * F.pow(beta / (beta + t_cal), s)
    for i in range(k):
        stay = stay * (r + i) / (i + 1) * hit

    top = F.greatest(alpha, beta)
    gap = F.abs(alpha - beta)
    second = F.when(alpha >= beta, s + 1).otherwise(r + k)
    bottom = r + s + k + 1
    from_start = hyp2f1(r + s, second, bottom, gap / top) / F.pow(top, r + s)
    past_end = F.lit(0.0)
    weight = F.lit(1.0)
    for i in range(k + 1):
        if i:
            weight = weight * (r + s + (i - 1)) / i * t_cal
        series = hyp2f1(r + s + i, second, bottom, gap / (top + t_cal))
        past_end = past_end + weight * series / F.pow(top + t_cal, r + s + i)
    # B(r+k, s+1) / B(r, s)
    ratio = F.exp(log_gamma(r + k) - log_gamma(r) + F.log(s) - log_rising(r + s, F.lit(k + 1)))
    left = F.pow(alpha, r) * F.pow(beta, s) * ratio * (from_start - past_end)
    return stay + left
