"""Gamma-Gamma spend model (Fader & Hardie 2013) as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.functions.special import Derivatives, digamma, log_gamma, trigamma

PARAMETERS = ("p", "q", "gamma")


def log_likelihood(params: Mapping[str, Column], m_x: Column, x: Column) -> Column:
    """Log density of a mean spend ``m_x`` over ``x`` > 0 purchases."""
    p, q, gamma = (params[name] for name in PARAMETERS)
    px = p * x
    return (
        log_gamma(px + q)
        - log_gamma(px)
        - log_gamma(q)
        + q * F.log(gamma)
        + (px - 1) * F.log(m_x)
        + px * F.log(x)
        - (px + q) * F.log(gamma + m_x * x)
    )


def derivatives(params: Mapping[str, Column], m_x: Column, x: Column) -> Derivatives:
    """First and second derivatives of ``log_likelihood`` by p, q and gamma."""
    p, q, gamma = (params[name] for name in PARAMETERS)
    steps = [
        {"_px": p * x, "_whole": gamma + m_x * x},
        {
            "_both": digamma(F.col("_px") + q) - F.log("_whole"),
            "_own": digamma(F.col("_px")),
            "_bent": trigamma(F.col("_px") + q),
            "_own_bent": trigamma(F.col("_px")),
        },
    ]
    px, whole, both, bent = (F.col(c) for c in ("_px", "_whole", "_both", "_bent"))
    first = [
        x * (both - F.col("_own") + F.log(m_x) + F.log(x)),
        both - digamma(q) + F.log(gamma),
        q / gamma - (px + q) / whole,
    ]
    second = [
        [x * x * (bent - F.col("_own_bent")), x * bent, -x / whole],
        [bent - trigamma(q), 1 / gamma - 1 / whole],
        [(px + q) / (whole * whole) - q / (gamma * gamma)],
    ]
    return Derivatives(steps, first, second)


def expected_spend(params: Mapping[str, Column], m_x: Column, x: Column) -> Column:
    """Expected spend per purchase; for x = 0 this is the population mean.

    Null where the mean does not exist (p x + q <= 1).
    """
    p, q, gamma = (params[name] for name in PARAMETERS)
    shape = p * x + q - 1
    return F.when(shape > 0, F.try_divide(p * (gamma + m_x * x), shape))
