"""Special functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tillscope.session import ship_package


def as_column(value: Column | float | int | str) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Spark does not share repeated expressions that contain a lambda.
    """
    return F.transform(F.array(value), body)[0]


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0: Stirling's series at z + 8, shifted back.

    Absolute error below 1e-12; stays inside generated code, unlike a fold over
    an array.
    """
    y = z + 8
    inv = 1 / y
    inv2 = inv * inv
    tail = inv * (
        1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 * (1 / 1188))))
    )
    shift = z
    for i in range(1, 8):
        shift = shift * (z + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(shift)


class Derivatives(NamedTuple):
    """Derivatives of a row's log-likelihood, on top of columns shared between them.

    ``steps`` are added one after the other; ``second`` is the upper triangle by rows.
    """

    steps: list[dict[str, Column]]
    first: list[Column]
    second: list[list[Column]]


def digamma(z: Column) -> Column:
    """The derivative of ln Gamma at z > 0: the series at z + 8, shifted back."""
    y = z + 8
    inv2 = 1 / (y * y)
    tail = inv2 * (
        1 / 12
        - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 * (1 / 132 - inv2 * (691 / 32760)))))
    )
    shift = 1 / z
    for i in range(1, 8):
        shift = shift + 1 / (z + i)
    return F.log(y) - 0.5 / y - tail - shift


def trigamma(z: Column) -> Column:
    """The second derivative of ln Gamma at z > 0."""
    y = z + 8
    inv2 = 1 / (y * y)
    tail = (1 / y) * inv2 * (
        1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * (5 / 66 - inv2 * (691 / 2730)))))
    )
    shift = 1 / (z * z)
    for i in range(1, 8):
        shift = shift + 1 / ((z + i) * (z + i))
    return 1 / y + 0.5 * inv2 + tail + shift


def log_rising(z: Column, n: Column) -> Column:
    """ln of the rising factorial z (z+1) ... (z+n-1)."""
    return log_gamma(z + n) - log_gamma(z)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_add(u: Column, v: Column) -> Column:
    """ln(exp(u) + exp(v)) without overflow; a null side counts as zero."""
    both = F.greatest(u, v) + F.log1p(F.exp(-F.abs(u - v)))
    return F.coalesce(both, u, v)


# Beyond this many terms a row has not converged, which raises.
_MOST_TERMS = 200_000


def _unsettled(name: str, z: np.ndarray) -> ArithmeticError:
    return ArithmeticError(f"{name} has not converged after {_MOST_TERMS} terms at z = {z[0]!r}")


def _series(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum the power series until every row's term has vanished."""
    total = np.ones_like(z)
    rows = np.arange(z.size)
    term = np.ones_like(z)
    n = 0
    while rows.size:
        term = term * ((a[rows] + n) * (b[rows] + n) / ((c[rows] + n) * (n + 1.0))) * z[rows]
        total[rows] += term
        n += 1
        # Late terms shrink at least by about |z| each, so this bounds the rest.
        going = np.abs(term) > 1e-16 * (1.0 - np.abs(z[rows])) * np.abs(total[rows])
        going |= n < -np.minimum(a[rows], b[rows])
        rows, term = rows[going], term[going]
        if n > _MOST_TERMS and rows.size:
            raise _unsettled("hypergeometric series", z[rows])
    return total


def _fraction(b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """F(1, b; c; z) by Gauss' continued fraction (Lentz' method).

    Needs about 1/sqrt(1 - z) steps where the series needs 1/(1 - z).
    """
    value = np.ones_like(z)
    rows = np.arange(z.size)
    up, down = np.ones_like(z), np.zeros_like(z)
    n = 0
    while rows.size:
        k, odd = divmod(n, 2)
        bb, cc = b[rows], c[rows]
        if odd:
            part = (k + 1) * (cc - bb + k) / ((cc + 2 * k) * (cc + 2 * k + 1))
        elif k:
            part = (bb + k) * (cc + k - 1) / ((cc + 2 * k - 1) * (cc + 2 * k))
        else:
            part = bb / cc
        part = -part * z[rows]
        down = 1.0 / (1.0 + part * down)
        up = 1.0 + part / up
        change = up * down
        value[rows] *= change
        going = np.abs(change - 1.0) > 3e-16  # one unit in the last place either way
        rows, up, down = rows[going], up[going], down[going]
        n += 1
        if n > _MOST_TERMS and rows.size:
            raise _unsettled("continued fraction", z[rows])
    return 1.0 / value


def _hyp2f1_values(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    # Euler's transformation first where it makes the terms smaller.
    euler = np.abs((c - a) * (c - b)) < np.abs(a * b)
    factor = np.where(euler, (1.0 - z) ** np.where(euler, c - a - b, 0.0), 1.0)
    a, b = np.where(euler, c - a, a), np.where(euler, c - b, b)
    # A parameter equal to 1, up to the rounding of the subtraction above.
    one_a, one_b = np.abs(a - 1.0) < 1e-9, np.abs(b - 1.0) < 1e-9
    simple = (one_a | one_b) & (z > 0)
    b = np.where(simple & ~one_a, a, b)
    out = np.empty_like(z)
    out[simple] = _fraction(b[simple], c[simple], z[simple])
    out[~simple] = _series(a[~simple], b[~simple], c[~simple], z[~simple])
    return factor * out


@F.pandas_udf(DoubleType())
def _hyp2f1(a: pd.Series, b: pd.Series, c: pd.Series, z: pd.Series) -> pd.Series:
    out = np.full(len(z), np.nan)
    args = [s.to_numpy(dtype=float) for s in (a, b, c, z)]
    # Null or out-of-range rows stay NaN.
    good = np.isfinite(np.sum(args, axis=0)) & (np.abs(args[3]) < 1)
    out[good] = _hyp2f1_values(*[v[good] for v in args])
    return pd.Series(out)


def hyp2f1(a: Column, b: Column, c: Column, z: Column) -> Column:
    """Gauss' hypergeometric function for |z| < 1 and c > 0.

    The one place where an Arrow batch goes to Python: a data-dependent number
    of terms has no generated-code form, and a fold over ``sequence`` is
    interpreted, 30 times slower per row than this vectorised sum (measured).
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        ship_package(session)
    return _hyp2f1(*[v.cast("double") for v in (a, b, c, z)])


# Steps of the continued fraction; it needs about the root of the smaller degrees of freedom.
_BETA_STEPS = 400


def _log_incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """ln I_x(a, b) for x below (a + 1) / (a + b + 2); ``rest`` is 1 - x.

    Lentz' form of the continued fraction, a fixed number of steps.
    """
    both = a + b

    def step(state: Column, n: Column) -> Column:
        m = n.cast("double")
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        d = 1 / (1 + even * state["d"])
        c = 1 + even / state["c"]
        half = state["h"] * d * c
        odd = -(a + m) * (both + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d2 = 1 / (1 + odd * d)
        c2 = 1 + odd / c
        return F.struct(c2.alias("c"), d2.alias("d"), (half * d2 * c2).alias("h"))

    first = 1 / (1 - both * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.sequence(F.lit(1), F.lit(_BETA_STEPS))
    fraction = F.aggregate(steps, start, step, lambda s: s["h"])
    return a * F.log(x) + b * F.log(rest) - log_beta(a, b) - F.log(a) + F.log(fraction)


def log_f_tail(f: Column, df_between: Column, df_within: Column) -> Column:
    """ln of the chance that an F variable exceeds ``f``; null where a figure is null or f < 0.

    The regularised incomplete beta function, through the tail whose continued
    fraction is short. In logarithms, so that tails below 1e-308 keep their size.
    """
    a, b = df_within.cast("double") / 2, df_between.cast("double") / 2
    top = df_between * f
    x, rest = df_within / (df_within + top), top / (df_within + top)
    direct = _log_incomplete_beta(a, b, x, rest)
    other = F.log1p(-F.exp(_log_incomplete_beta(b, a, rest, x)))
    tail = F.when(x < (a + 1) / (a + b + 2), direct).otherwise(other)
    return F.when(f == 0, F.lit(0.0)).when(f > 0, tail)


# A window in which the integrand below falls by this many powers of e, and the nodes on it: over the
# box 1e-4 to 1e4 of the parameters the error stays below 1e-11.
_REACH, _NODES = 40.0, 48
# Windows no wider than 3 with a fall of at most 20 need no more nodes than this for 1e-13.
_SHORT_WIDTH, _SHORT_FALL, _SHORT_NODES = 3.0, 20.0, 16


def _gauss_nodes(n: int) -> Column:
    places, weights = np.polynomial.legendre.leggauss(n)
    pairs = zip((places + 1) / 2, weights / 2, strict=True)
    return F.array(*[F.struct(F.lit(float(u)).alias("at"), F.lit(float(w)).alias("weight")) for u, w in pairs])


def log_power_integral(a: Column, b: Column, p: Column, q: Column, start: Column, end: Column) -> Column:
    """ln of the integral of (a + y)^-p (b + y)^-q from ``start`` to ``end``; null unless end > start.

    For a, b, p, q > 0, start >= 0, and of the exponents that of the larger of a and b at
    least 1 wherever the other is below 1. With v = ln((near + y) / (near + start)), near being
    the smaller of a and b, the logarithm of the integrand is concave and smooth, so that a
    fixed number of Gauss-Legendre nodes is enough on the part that is not negligible, whose
    width has a closed form. Stays in the JVM; no difference of close numbers is formed.
    """
    a, b, p, q, start, end = (v.cast("double") for v in (a, b, p, q, start, end))
    near, far = F.least(a, b), F.greatest(a, b)
    inner, outer = F.when(a <= b, p).otherwise(q), F.when(a <= b, q).otherwise(p)
    width = F.log1p((end - start) / (near + start))
    share = (near + start) / (far + start)
    # The integrand rises by no more than this before it falls.
    rise = F.greatest(1 - inner, F.lit(0.0)) * width
    reach = F.least(
        width,
        F.when(inner > 1, _REACH / (inner - 1)),
        F.log1p(F.expm1((_REACH + rise) / outer) / share),
    )
    few, many = _gauss_nodes(_SHORT_NODES), _gauss_nodes(_NODES)

    def total(row: Column) -> Column:
        def log_value(v: Column) -> Column:
            return row["slope"] * v - row["outer"] * F.log1p(row["share"] * F.expm1(v))

        def add(so_far: Column, node: Column) -> Column:
            return so_far + node["weight"] * F.exp(log_value(node["at"] * row["reach"]))

        short = (row["reach"] <= _SHORT_WIDTH) & (log_value(row["reach"]) >= -_SHORT_FALL)
        nodes = F.when(short, few).otherwise(many)
        return F.log(F.aggregate(nodes, F.lit(0.0), add) * row["reach"])

    shared = F.struct(
        reach.alias("reach"), (1 - inner).alias("slope"), outer.alias("outer"), share.alias("share")
    )
    scale = F.log(near + start) - p * F.log(a + start) - q * F.log(b + start)
    return F.when(end > start, let(shared, total) + scale)


def log_power_integrals(
    a: float, b: float, p: np.ndarray, q: float, start: np.ndarray, end: float
) -> np.ndarray:
    """``log_power_integral`` for one ``a``, ``b``, ``q`` and ``end``, over arrays; -inf at ``start = end``."""
    inner, outer = (p, q) if a <= b else (q, p)
    near = min(a, b)
    width = np.log1p((end - start) / (near + start))
    share = (near + start) / (max(a, b) + start)
    rise = np.maximum(1 - inner, 0.0) * width
    with np.errstate(divide="ignore", over="ignore"):
        falls = np.where(inner > 1, _REACH / np.maximum(inner - 1, 0.0), np.inf)
        reach = np.minimum(np.minimum(width, falls), np.log1p(np.expm1((_REACH + rise) / outer) / share))
        slope, outer = np.broadcast_to(1 - inner, width.shape), np.broadcast_to(outer, width.shape)

        def log_value(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return slope[rows] * v - outer[rows] * np.log1p(share[rows] * np.expm1(v))

        every = np.arange(width.size)
        short = (reach <= _SHORT_WIDTH) & (log_value(reach, every) >= -_SHORT_FALL)
        total = np.zeros_like(width)
        for rows, n in ((every[short], _SHORT_NODES), (every[~short], _NODES)):
            for place, weight in zip(*np.polynomial.legendre.leggauss(n), strict=True):
                total[rows] += weight / 2 * np.exp(log_value((place + 1) / 2 * reach[rows], rows))
        scale = np.log(near + start) - p * np.log(a + start) - q * np.log(b + start)
        return np.log(total * reach) + scale
