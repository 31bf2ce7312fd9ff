"""Derivatives against differences, and Newton fits against the candidate search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.functions.special import digamma, log_gamma, trigamma
from tillscope.operators import fitting, lifetime, newton


def test_digamma_and_trigamma_are_derivatives_of_log_gamma(spark):
    points = [0.01, 0.3, 1.0, 2.5, 7.0, 40.0, 1234.5, 1e6]
    frame = spark.createDataFrame([(z,) for z in points], "z double")
    z = F.col("z")
    for r in frame.select("z", digamma(z).alias("d"), trigamma(z).alias("t"), log_gamma(z).alias("g")).collect():
        h = 1e-4 * r["z"]
        slope = (math.lgamma(r["z"] + h) - math.lgamma(r["z"] - h)) / (2 * h)
        assert r["d"] == pytest.approx(slope, rel=1e-6, abs=1e-6)
    known = {r["z"]: (r["d"], r["t"]) for r in frame.select("z", digamma(z).alias("d"), trigamma(z).alias("t")).collect()}
    assert known[1.0][0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert known[1.0][1] == pytest.approx(math.pi**2 / 6, abs=1e-13)
    # Both follow their recursion from z to z + 1.
    up = frame.select("z", (digamma(z + 1) - digamma(z)).alias("d"), (trigamma(z) - trigamma(z + 1)).alias("t"))
    for r in up.collect():
        assert r["d"] == pytest.approx(1 / r["z"], rel=1e-6, abs=1e-13)
        assert r["t"] == pytest.approx(1 / r["z"] ** 2, rel=1e-3, abs=1e-13)


def _history(spark, n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = int(rng.poisson(rng.gamma(1.5, 2.0))) if i % 3 else 0
        t_cal = float(rng.uniform(30, 60))
        rows.append((str(i), x, float(rng.uniform(0.3, 1) * t_cal) if x else 0.0, t_cal, float(rng.gamma(6, 40))))
    return spark.createDataFrame(rows, "cust string, x long, t_x double, t_cal double, m_x double")


CASES = {
    "bgnbd": (lifetime.bgnbd_log_likelihood, newton.bgnbd_derivatives, {"r": 0.8, "alpha": 9.0, "a": 0.7, "b": 2.5}),
    "spend": (lifetime.spend_log_likelihood, newton.spend_derivatives, {"p": 3.0, "q": 5.0, "gamma": 200.0}),
}


@pytest.mark.parametrize("name", CASES)
def test_sums_equal_differences(spark, name):
    objective, derivatives, params = CASES[name]
    data = _history(spark).where("x > 0") if name == "spend" else _history(spark)
    names = list(params)

    data = data.cache()
    model = newton.Sums(objective, derivatives, list(params))

    def at(moved):
        return model.over(data, moved).first()

    middle = at(params)
    size, bend = len(names), iter(middle["bend"])
    for i, one in enumerate(names):
        h = 1e-4 * params[one]
        up, down = at({**params, one: params[one] + h}), at({**params, one: params[one] - h})
        assert middle["score"][i] == pytest.approx((up["value"] - down["value"]) / (2 * h), rel=1e-5, abs=1e-4)
        for j in range(i, size):
            difference = (up["score"][j] - down["score"][j]) / (2 * h)
            assert next(bend) == pytest.approx(difference, rel=1e-4, abs=1e-4)


def _spent(spark, n=3000):
    rng = np.random.default_rng(8)
    p, q, gamma = 5.0, 6.0, 200.0
    rows = []
    for i in range(n):
        x = int(rng.integers(1, 8))
        nu = rng.gamma(q, 1 / gamma)
        rows.append((str(i), x, float(rng.gamma(p * x, 1 / (nu * x)))))
    return spark.createDataFrame(rows, "cust string, x long, m_x double")


def test_the_spend_fit_finds_the_optimum_of_the_search_in_fewer_jobs(spark):
    history = _spent(spark)
    fast, slow = newton.fit_spend(history).first(), fitting.fit_spend(history).first()
    assert fast["converged"] and not fast["at_edge"]
    assert fast["log_likelihood"] >= slow["log_likelihood"] - 1e-4
    for name, truth in (("p", 5.0), ("q", 6.0), ("gamma", 200.0)):
        assert fast[name] == pytest.approx(slow[name], rel=0.02)
        assert fast[name] == pytest.approx(truth, rel=0.25)
    assert fast["rounds_used"] <= 15


def _bought(spark, n=4000):
    rng = np.random.default_rng(9)
    r, alpha, a, b = 1.2, 8.0, 0.9, 3.0
    rows = []
    for i in range(n):
        rate, leave, t_cal = rng.gamma(r, 1 / alpha), rng.beta(a, b), float(rng.integers(30, 60))
        at, x, t_x = rng.exponential(1 / rate), 0, 0.0
        while at < t_cal:
            x, t_x = x + 1, round(at, 1)
            if rng.random() < leave:
                break
            at += rng.exponential(1 / rate)
        rows.append((str(i), x, t_x, t_cal))
    return spark.createDataFrame(rows, "cust string, x long, t_x double, t_cal double")


def test_the_purchase_fit_finds_the_optimum_of_the_search(spark):
    history = _bought(spark)
    fast, slow = newton.fit_bgnbd(history).first(), fitting.fit_bgnbd(history).first()
    assert fast["converged"] and not fast["at_edge"]
    assert fast["log_likelihood"] >= slow["log_likelihood"] - 1e-4
    for name, truth in (("r", 1.2), ("alpha", 8.0), ("a", 0.9), ("b", 3.0)):
        assert fast[name] == pytest.approx(slow[name], rel=0.05)
        assert fast[name] == pytest.approx(truth, rel=0.4)


def test_an_unidentified_parameter_ends_on_the_edge(spark):
    rows = [(str(i), 3, float(20 + i % 5), 40.0) for i in range(200)]
    fitted = newton.fit_bgnbd(spark.createDataFrame(rows, "cust string, x long, t_x double, t_cal double"))
    assert fitted.first()["at_edge"]


def test_no_rows_do_not_converge(spark):
    row = newton.fit_spend(_spent(spark, 1).limit(0)).first()
    assert row["log_likelihood"] is None and not row["converged"]
