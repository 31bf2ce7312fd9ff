"""Formulas at the edges of their parameters, unfinished fits, dates, shuffle sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.functions import bgnbd, gamma_gamma, pnbd, special
from tillscope.operators import cleaning, fitting, lifetime
from tillscope.session import partitions_for


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def _lits(**values):
    return {k: F.lit(float(v)) for k, v in values.items()}


def _bgnbd(spark, a, b, x=2.0):
    params = _lits(r=0.8, alpha=5.0, a=a, b=b)
    return _value(
        spark,
        bgnbd.expected_purchases(params, F.lit(x), F.lit(20.0 if x else 0.0), F.lit(30.0), F.lit(52.0)),
    )


def test_bgnbd_at_its_limits(spark):
    around = (_bgnbd(spark, 0.999, 2.0) + _bgnbd(spark, 1.001, 2.0)) / 2
    assert math.isclose(_bgnbd(spark, 1.0, 2.0), around, rel_tol=1e-4)
    assert math.isclose(
        _bgnbd(spark, 0.5, 0.5, 0.0), _bgnbd(spark, 0.5, 0.5001, 0.0), rel_tol=1e-3
    )


def test_pnbd_at_s_one(spark):
    def value(s):
        params = _lits(r=0.8, alpha=5.0, s=s, beta=8.0)
        return _value(
            spark,
            pnbd.expected_purchases(params, F.lit(2.0), F.lit(20.0), F.lit(30.0), F.lit(52.0)),
        )

    assert math.isclose(value(1.0), (value(0.999) + value(1.001)) / 2, rel_tol=1e-4)


def test_spend_without_a_mean_is_null(spark):
    def value(q, x):
        params = _lits(p=2.0, q=q, gamma=50.0)
        return _value(spark, gamma_gamma.expected_spend(params, F.lit(30.0), F.lit(x)))

    assert value(1.0, 0.0) is None and value(0.5, 0.0) is None
    assert value(0.5, 3.0) > 0 and value(3.0, 0.0) == 50.0


def test_undefined_predictions_stay_visible(spark):
    history = spark.createDataFrame(
        [("a", 0, 0.0, 30.0, None, None, None)],
        "cust string, x int, t_x double, t_cal double, m_x double, "
        "holdout_mean double, holdout_count long",
    ).fillna(0.0, ["m_x"])
    scored = lifetime.score(
        history,
        {"r": 0.8, "alpha": 5.0, "a": 0.5, "b": 0.5},
        {"r": 0.8, "alpha": 5.0, "s": 1.0, "beta": 8.0},
        {"p": 2.0, "q": 0.5, "gamma": 50.0},
    ).first()
    assert scored["spend"] is None and scored["clv_pred_bg"] is None
    assert scored["yearpred_bg"] > 0 and scored["clv_real"] == 0


def test_a_series_that_does_not_settle_raises():
    one = [np.array([v]) for v in (3.0, 2.0, 4.5, 0.999999)]
    with pytest.raises(ArithmeticError, match="has not converged"):
        special._hyp2f1_values(*one)


def test_unfinished_fits_raise(spark):
    schema = (
        "r double, log_likelihood double, at_edge boolean, converged boolean, rounds_used int"
    )
    unfinished = spark.createDataFrame([(1.5, -3.0, False, False, 40)], schema)
    with pytest.raises(ArithmeticError, match="40 rounds"):
        fitting.parameters(unfinished)
    assert fitting.parameters(unfinished, allow_unfinished=True) == {"r": 1.5}


def test_date_separators(spark):
    texts = ["1.2.2024", "01-02-2024", "1/02/2024", "2024", "", None, "31.2.2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(cleaning.parse_date("t").cast("string")).collect()]
    assert found == ["2024-02-01"] * 3 + [None] * 4


def test_shuffles_grow_with_the_input():
    assert partitions_for(0) == 16
    assert partitions_for(100 * 10**12) == math.ceil(100 * 10**12 / (64 << 20))
