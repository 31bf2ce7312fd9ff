"""BG/NBD purchase model (Fader, Hardie & Lee 2005) as column expressions.

``params`` maps r, alpha, a, b to columns; x, t_x and t_cal are the repeat count,
the week of the last purchase and the weeks observed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.functions.special import Derivatives, digamma, hyp2f1, log_add, log_rising, trigamma

PARAMETERS = ("r", "alpha", "a", "b")
_NEAR = 1e-6


def log_likelihood(params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column) -> Column:
    r, alpha, a, b = (params[name] for name in PARAMETERS)
    alive = -(r + x) * F.log(alpha + t_cal)
    gone = F.when(x > 0, F.log(a) - F.log(b + x - 1) - (r + x) * F.log(alpha + t_x))
    return (
        log_rising(r, x)
        + r * F.log(alpha)
        + log_rising(b, x)
        - log_rising(a + b, x)
        + log_add(alive, gone)
    )


def derivatives(
    params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column
) -> Derivatives:
    """First and second derivatives of ``log_likelihood`` by r, alpha, a and b.

    The customer is still there or left after the last purchase; ``_left`` is the
    chance of the latter, and the logarithm of the two cases' sum adds its variance
    to the curvature. ``_gap`` columns are how far the slopes of the cases differ.
    """
    r, alpha, a, b = (params[name] for name in PARAMETERS)
    n, now, then, last = (F.col(c) for c in ("_n", "_now", "_then", "_last"))
    left, ended, bent = (F.col(c) for c in ("_left", "_ended", "_bent"))

    def if_repeated(value: Column) -> Column:
        return F.when(x > 0, value).otherwise(0.0)

    odds = F.log(a) - F.log(last) + n * F.col("_gap0")
    steps = [
        {"_n": r + x, "_now": alpha + t_cal, "_then": alpha + t_x, "_last": b + x - 1},
        {"_gap0": if_repeated(F.log(now) - F.log(then))},
        {
            "_left": if_repeated(1 / (1 + F.exp(-odds))),
            "_gap1": if_repeated(n / now - n / then),
            "_gap2": if_repeated(1 / a),
            "_gap3": if_repeated(-1 / last),
            "_ended": digamma(a + b) - digamma(a + b + x),
            "_bent": trigamma(a + b) - trigamma(a + b + x),
        },
        {"_unsure": left * (1 - left)},
    ]
    gaps = [F.col(f"_gap{i}") for i in range(4)]
    first = [
        digamma(n) - digamma(r) + F.log(alpha) - F.log(now) + left * gaps[0],
        r / alpha - n / now + left * gaps[1],
        ended + left * gaps[2],
        digamma(b + x) - digamma(b) + ended + left * gaps[3],
    ]
    own = {
        (0, 0): trigamma(n) - trigamma(r),
        (0, 1): 1 / alpha - (1 - left) / now - left / then,
        (1, 1): (1 - left) * n / (now * now) + left * n / (then * then) - r / (alpha * alpha),
        (2, 2): bent - left / (a * a),
        (2, 3): bent,
        (3, 3): trigamma(b + x) - trigamma(b) + bent + if_repeated(left / (last * last)),
    }
    second = [
        [own.get((i, j), F.lit(0.0)) + F.col("_unsure") * gaps[i] * gaps[j] for j in range(i, 4)]
        for i in range(4)
    ]
    return Derivatives(steps, first, second)


def expected_purchases(
    params: Mapping[str, Column], x: Column, t_x: Column, t_cal: Column, horizon: Column
) -> Column:
    """Purchases expected in the next ``horizon`` weeks given the history.

    The formula has finite limits at a = 1 and at a + b + x = 1; within 1e-6 of
    them it is taken 1e-6 away, which changes it by about as much.
    """
    r, alpha, a, b = (params[name] for name in PARAMETERS)
    a = F.when(F.abs(a - 1) < _NEAR, 1 + _NEAR).otherwise(a)
    end = alpha + t_cal + horizon
    third = a + b + x - 1
    third = F.when(F.abs(third) < _NEAR, _NEAR).otherwise(third)
    series = hyp2f1(r + x, b + x, third, horizon / end)
    no_more = F.exp((r + x) * F.log((alpha + t_cal) / end)) * series
    gone = F.when(
        x > 0,
        a / (b + x - 1) * F.exp((r + x) * F.log((alpha + t_cal) / (alpha + t_x))),
    ).otherwise(0.0)
    return third / (a - 1) * (1 - no_more) / (1 + gone)


def pmf(params: Mapping[str, Column], k: int, t_cal: Column) -> Column:
    """Probability of exactly k repeat purchases in ``t_cal`` weeks."""
    r, alpha, a, b = (params[name] for name in PARAMETERS)
    miss, hit = alpha / (alpha + t_cal), t_cal / (alpha + t_cal)
    base = F.pow(miss, r)

    def poisson_gamma(j: int) -> Column:
        weight = base
        for i in range(j):
            weight = weight * (r + i) / (i + 1) * hit
        return weight

    survive = F.lit(1.0)
    for i in range(k):
        survive = survive * (b + i) / (a + b + i)
    still_in = survive * poisson_gamma(k)
    if k == 0:
        return still_in
    # B(a+1, b+k-1) / B(a, b): survived k-1 times, then left.
    leave = a / (a + b + (k - 1))
    for i in range(k - 1):
        leave = leave * (b + i) / (a + b + i)
    reached = 1 - sum((poisson_gamma(j) for j in range(1, k)), poisson_gamma(0))
    return still_in + leave * reached
