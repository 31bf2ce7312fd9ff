"""Event log, purchase history, models and fits."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.functions import bgnbd, gamma_gamma, pnbd, special
from tillscope.functions.special import hyp2f1, log_gamma
from tillscope.operators import fitting, lifetime

LINES = "customer_id string, date date, order_value_ex_vat_ex_freight double"
CUTOFF = "2024-03-01"


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def _lits(**values):
    return {k: F.lit(float(v)) for k, v in values.items()}


def _at(*values):
    return [F.lit(float(v)) for v in values]


def test_log_gamma(spark):
    z = [0.03, 0.5, 1.0, 2.0, 7.7, 54.0, 1e4]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select(log_gamma(F.col("z"))).collect()
    assert [r[0] for r in rows] == pytest.approx([math.lgamma(v) for v in z], rel=1e-13, abs=1e-11)


def test_hypergeometric_known_values(spark):
    # F(1,1;2;z) = -ln(1-z)/z and F(a,b;b;z) = (1-z)^-a
    for z in (0.0001, 0.3, 0.9, 0.999999):
        got = _value(spark, hyp2f1(*_at(1, 1, 2, z)))
        assert got == pytest.approx(-math.log1p(-z) / z, rel=1e-11)
    assert _value(spark, hyp2f1(*_at(2.3, 1.7, 1.7, 0.6))) == pytest.approx(0.4**-2.3, rel=1e-12)
    assert _value(spark, hyp2f1(*_at(0.4, 2.5, 3.5, 0.0))) == 1.0


def test_bgnbd_published_example(spark):
    params = _lits(r=0.243, alpha=4.414, a=0.793, b=2.426)
    got = _value(spark, bgnbd.expected_purchases(params, *_at(2, 30.43, 38.86, 39)))
    assert got == pytest.approx(1.226028174767135, rel=1e-12)


@pytest.mark.parametrize(
    "params, history, want",
    [
        ((0.6, 10, 0.7, 12), (3, 20, 37), 6.735354681620638e-06),
        ((0.6, 14, 0.7, 9), (3, 20, 37), 5.258548645722126e-06),
        ((1.2, 8, 0.5, 11), (0, 0, 30), 0.3109875533045445),
    ],
)
def test_pnbd_likelihood_equals_integration(spark, params, history, want):
    columns = _lits(**dict(zip(pnbd.PARAMETERS, params, strict=True)))
    got = _value(spark, pnbd.log_likelihood(columns, *_at(*history)))
    assert math.exp(got) == pytest.approx(want, rel=1e-11)


def test_pnbd_dropout_integral(spark):
    """P(alive) against a plain numerical integral over the drop-out time."""
    r, alpha, s, beta, x, t_x, t_cal = 0.8, 3.0, 1.4, 20.0, 2, 9.0, 31.0
    y = np.linspace(t_x, t_cal, 400_001)
    density = s * beta**s * (alpha + y) ** -(r + x) * (beta + y) ** -(s + 1)
    gone = float(np.sum((density[1:] + density[:-1]) / 2) * (y[1] - y[0]))
    alive = (alpha + t_cal) ** -(r + x) * (beta / (beta + t_cal)) ** s
    columns = _lits(r=r, alpha=alpha, s=s, beta=beta)
    got = _value(spark, pnbd.p_alive(columns, *_at(x, t_x, t_cal)))
    assert got == pytest.approx(alive / (alive + gone), rel=1e-8)


@pytest.mark.parametrize(
    "model, params",
    [
        (bgnbd, (0.8, 6, 0.9, 3)),
        (pnbd, (0.8, 6, 0.9, 12)),
        (pnbd, (0.8, 12, 1.9, 6)),
    ],
)
def test_frequency_probabilities_sum_to_one(spark, model, params):
    columns = _lits(**dict(zip(model.PARAMETERS, params, strict=True)))
    share = [model.pmf(columns, k, F.lit(2.0)) for k in range(10)]
    got = spark.range(1).select(*[p.alias(f"p{k}") for k, p in enumerate(share)]).first()
    assert all(p > 0 for p in got)
    assert sum(got) == pytest.approx(1.0, abs=2e-4)


def test_spend_model_without_repeats_is_the_population_mean(spark):
    columns = _lits(p=6, q=4, gamma=15)
    for m_x in (0.0, 99.0):
        assert _value(spark, gamma_gamma.expected_spend(columns, *_at(m_x, 0))) == 6 * 15 / 3


def test_single_purchase_has_finite_likelihoods(spark):
    history = _at(0, 0, 12)
    for model, params in ((bgnbd, (0.8, 6, 0.9, 3)), (pnbd, (0.8, 6, 0.9, 12))):
        columns = _lits(**dict(zip(model.PARAMETERS, params, strict=True)))
        assert math.isfinite(_value(spark, model.log_likelihood(columns, *history)))
        assert _value(spark, model.expected_purchases(columns, *history, F.lit(10.0))) > 0


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("same", dt.date(2024, 1, 1), 3.0),
        ("same", dt.date(2024, 1, 1), 4.0),
        ("twice", dt.date(2024, 1, 1), 1.0),
        ("twice", dt.date(2024, 1, 15), 2.0),
        ("twice", dt.date(2024, 4, 1), 5.0),
        ("edge", dt.date(2024, 2, 29), 1.0),
        ("new", dt.date(2024, 3, 1), 1.0),
        *[("busy", dt.date(2024, 1, 1) + dt.timedelta(d), 1.0) for d in range(5)],
    ]
    return spark.createDataFrame(rows, LINES)


def test_event_log_merges_days_and_filters_customers(lines):
    log = lifetime.event_log(lines, CUTOFF, max_transactions=5).collect()
    assert {r["cust"] for r in log} == {"same", "twice", "edge"}
    assert [r["sales"] for r in log if r["cust"] == "same"] == [7.0]
    kept = lifetime.exclude_newcomers(lines, CUTOFF)
    assert {r["customer_id"] for r in kept.collect()} == {"same", "twice", "edge", "busy"}


def test_purchase_history_in_weeks(lines):
    log = lifetime.event_log(lines, CUTOFF)
    history = {r["cust"]: r for r in lifetime.purchase_history(log, CUTOFF).collect()}
    assert (history["same"]["x"], history["same"]["t_x"]) == (0, 0.0)
    twice = history["twice"]
    assert (twice["x"], twice["t_x"], twice["m_x"]) == (1, 2.0, 1.5)
    assert twice["t_cal"] == pytest.approx((dt.date(2024, 2, 29) - dt.date(2024, 1, 1)).days / 7)
    assert (twice["holdout_mean"], twice["holdout_count"]) == (5.0, 1)
    assert history["edge"]["t_cal"] == 0.0
    days = lifetime.cbt(log, CUTOFF).where("cust = 'twice'").collect()
    assert [(r["date"], r["purchases"]) for r in days] == [(dt.date(2024, 1, 15), 1)]


def test_missing_holdout_counts_as_zero(lines):
    history = lifetime.purchase_history(lifetime.event_log(lines, CUTOFF), CUTOFF)
    scored = lifetime.score(
        history,
        dict(r=0.8, alpha=6, a=0.9, b=3),
        dict(r=0.8, alpha=6, s=0.9, beta=12),
        dict(p=6, q=4, gamma=15),
    )
    rows = {r["cust"]: r for r in scored.collect()}
    assert rows["same"]["clv_real"] == 0.0
    assert rows["twice"]["clv_real"] == 5.0
    assert not any(v is None for r in rows.values() for v in r)
    stats = {r["model"]: r for r in lifetime.evaluate(scored).collect()}
    assert set(stats) == {"Pareto/NBD", "BG/NBD"}
    assert stats["BG/NBD"]["rmse"] >= stats["BG/NBD"]["mae"]


def test_histogram_keeps_every_row(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 69.9, 7000.0, 7001.0)], "v double")
    rows = {r["bucket"]: r["n"] for r in lifetime.histogram(df, ["v"], high=7000.0, bins=50).collect()}
    assert rows == {0: 1, 1: 2, 50: 1, 51: 1}


def test_compressed_likelihood_equals_row_likelihood(spark, lines):
    history = lifetime.purchase_history(lifetime.event_log(lines, CUTOFF), CUTOFF)
    params = [dict(r=0.8, alpha=6.0, a=0.9, b=3.0)]
    names = list(params[0])
    value = fitting.weighted(lifetime.bgnbd_log_likelihood, names, None)
    by_row = fitting.score_candidates(history, params, value).first()["log_likelihood"]
    value = fitting.weighted(lifetime.bgnbd_log_likelihood, names, "weight")
    packed = fitting.score_candidates(lifetime.compress(history), params, value).first()
    assert packed["log_likelihood"] == pytest.approx(by_row, rel=1e-12)


def _purchases(rng, n, rate, life):
    span = rng.integers(10, 52, n).astype(float)
    end = np.minimum(span, life)
    x = rng.poisson(rate * end)
    last = np.where(x > 0, end * rng.random(n) ** (1 / np.maximum(x, 1)), 0.0)
    return pd.DataFrame({"x": x, "t_x": last, "t_cal": span})


def test_fit_recovers_pareto_parameters(spark):
    rng = np.random.default_rng(7)
    n = 8000
    rate, leave = rng.gamma(0.8, 1 / 6.0, n), rng.gamma(1.2, 1 / 12.0, n)
    df = spark.createDataFrame(_purchases(rng, n, rate, rng.exponential(1 / leave)))
    fitted = fitting.fit_pnbd(df)
    got, row = fitting.parameters(fitted), fitted.first()
    assert not row["at_edge"]
    assert got["r"] == pytest.approx(0.8, rel=0.15)
    assert got["alpha"] == pytest.approx(6.0, rel=0.15)
    truth = [dict(r=0.8, alpha=6.0, s=1.2, beta=12.0)]
    value = fitting.weighted(lifetime.pnbd_log_likelihood, list(truth[0]), "weight")
    at_truth = fitting.score_candidates(lifetime.compress(df), truth, value).first()
    assert row["log_likelihood"] >= at_truth["log_likelihood"]


def test_fit_recovers_spend_parameters(spark):
    rng = np.random.default_rng(3)
    n = 8000
    x = rng.integers(1, 8, n)
    rate = rng.gamma(4.0, 1 / 15.0, n)
    spend = rng.gamma(6.0 * x, 1 / (rate * x))
    df = spark.createDataFrame(pd.DataFrame({"cust": x.astype(str), "x": x, "m_x": spend}))
    got = fitting.parameters(fitting.fit_spend(df))
    mean = got["p"] * got["gamma"] / (got["q"] - 1)
    assert mean == pytest.approx(6.0 * 15.0 / 3.0, rel=0.05)
    assert got["q"] == pytest.approx(4.0, rel=0.15)


def test_fit_marks_parameters_on_the_edge(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(_purchases(rng, 2000, np.full(2000, 0.1), np.full(2000, 99.0)))
    assert fitting.fit_bgnbd(df).first()["at_edge"]


def test_spend_density_equals_direct_kernel_sums(spark):
    rng = np.random.default_rng(6)
    spent = np.concatenate((rng.gamma(4, 30, 400), rng.normal(400, 20, 200)))
    rows = [(str(n), 1 + n % 3, float(v)) for n, v in enumerate(spent)] + [("no repeats", 0, 9e9)]
    history = spark.createDataFrame(rows, "cust string, x long, m_x double")
    found = lifetime.spend_density(history, 40, 4096).orderBy("point").collect()
    h = 1.06 * spent.std(ddof=1) * len(spent) ** -0.2
    for row in found:
        away = (row["value"] - spent) / h
        direct = np.exp(-0.5 * away**2).sum() / (len(spent) * h * np.sqrt(2 * np.pi))
        assert row["density"] == pytest.approx(direct, rel=1e-5)
    assert (found[0]["value"], found[-1]["value"]) == (spent.min(), pytest.approx(spent.max()))
    step = found[1]["value"] - found[0]["value"]
    assert 0.9 < sum(r["density"] for r in found) * step < 1  # some mass lies beyond the ends
    assert lifetime.spend_density(history.limit(1)).isEmpty()
    assert lifetime.spend_density(history.limit(0)).isEmpty()


def _dropout_by_series(r, alpha, s, beta, x, t_x, t_cal):
    """The closed form: the difference of two hypergeometric series."""
    top, total = np.maximum(alpha, beta), r + s + x
    second = np.where(alpha >= beta, s + 1, r + x)

    def log_part(y):
        z = np.abs(alpha - beta) / (top + y)
        return np.log(special._hyp2f1_values(total, second, total + 1, z)) - total * np.log(top + y)

    early, late = log_part(t_x), log_part(t_cal)
    with np.errstate(all="ignore"):
        return np.log(s / total) + late + np.log(np.expm1(early - late)), early - late


def test_pnbd_dropout_equals_the_series_over_the_box(spark):
    rng = np.random.default_rng(4)
    n = 3000
    r, alpha, s, beta = 10 ** rng.uniform(-4, 4, (4, n))
    x = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n)).astype(float)
    t_cal = 10 ** rng.uniform(0, 2.5, n)
    t_x = np.where(x == 0, 0, t_cal * rng.random(n))
    beta[:20] = alpha[:20]
    # Below a hundredth of the larger one the series takes up to a million terms.
    near = np.minimum(alpha, beta) > 0.01 * (np.maximum(alpha, beta))
    want, gap = _dropout_by_series(*[v[near] for v in (r, alpha, s, beta, x, t_x, t_cal)])
    frame = pd.DataFrame(
        {"r": r, "alpha": alpha, "s": s, "beta": beta, "x": x, "t_x": t_x, "t_cal": t_cal}
    )[near]
    params = {name: F.col(name) for name in pnbd.PARAMETERS}
    got = spark.createDataFrame(frame).select(
        pnbd._log_dropout(params, F.col("x"), F.col("t_x"), F.col("t_cal")).alias("v")
    )
    found = np.array([row["v"] for row in got.collect()], float)
    assert np.isfinite(found).all()
    # The difference of the series keeps digits only where it is not small, and its logarithms
    # only where total * ln(top + y) is not large.
    total = (r + s + x)[near]
    firm = (gap > 1e-2) & (gap < 600) & (total < 1e3)
    assert firm.sum() > 200
    error = np.abs(found - want)[firm]
    assert error.max() < 1e-10


def test_power_integral_against_plain_quadrature(spark):
    """Every corner of the box, where the series has no digits left."""
    rng = np.random.default_rng(8)
    n = 1500
    a, b, p, q = 10 ** rng.uniform(-4, 4, (4, n))
    a[:100], b[:100], p[:100], q[:100] = 10.0 ** rng.choice([-4, 4], (4, 100))
    end = 10 ** rng.uniform(-1, 3, n)
    start = np.where(rng.random(n) < 0.5, 0, end * rng.random(n))
    q = q + 1
    near, far = np.minimum(a, b), np.maximum(a, b)
    inner, outer = np.where(a <= b, p, q), np.where(a <= b, q, p)
    width, share = np.log1p((end - start) / (near + start)), (near + start) / (far + start)
    u, w = np.polynomial.legendre.leggauss(20)
    edges = np.concatenate([[0], np.geomspace(1e-7, 1, 120)])
    want = np.zeros(n)
    for low, high in zip(edges[:-1], edges[1:]):
        v = (low + (high - low) * (u + 1) / 2)[:, None] * width
        value = np.exp((1 - inner) * v - outer * np.log1p(share * np.expm1(v)))
        want += (w[:, None] * value).sum(0) * (high - low) / 2
    want = np.log(want * width) + np.log(near + start) - p * np.log(a + start) - q * np.log(b + start)
    frame = pd.DataFrame({"a": a, "b": b, "p": p, "q": q, "start": start, "end": end})
    got = spark.createDataFrame(frame).select(
        special.log_power_integral(*[F.col(c) for c in frame.columns]).alias("v")
    )
    found = np.array([row["v"] for row in got.collect()], float)
    # Logarithms of up to 1e5 keep about 1e-11.
    assert np.max(np.abs(found - want) / np.maximum(1, np.abs(want) * 1e-2)) < 1e-10


def test_power_integral_of_nothing_is_null(spark):
    for start, end in ((3, 3), (4, 3)):
        assert _value(spark, special.log_power_integral(*_at(1, 2, 3, 4, start, end))) is None
    missing = special.log_power_integral(*_at(1, 2, 3, 4, 0), F.lit(None).cast("double"))
    assert _value(spark, missing) is None


def test_pareto_values_need_no_python(spark, lines):
    history = lifetime.purchase_history(lifetime.event_log(lines, CUTOFF, 50), CUTOFF)
    params = dict(zip(pnbd.PARAMETERS, (0.8, 6.0, 0.9, 12.0), strict=True))
    frame = history.select(lifetime.pnbd_log_likelihood(params).alias("v"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    predicted = lifetime.predict_purchases(history, params, pnbd, "v")
    plan = predicted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("params", [(0.8, 6, 0.9, 12), (276, 1e4, 1e-4, 9900), (1e-4, 1e-4, 1e4, 1e4), (1e4, 1e-4, 0.3, 2)])
def test_pnbd_scores_share_integrals_and_equal_the_rows(spark, params):
    rng = np.random.default_rng(4)
    t_cal = rng.integers(1, 300, 2000) / 7
    t_x = np.minimum(np.floor(rng.random(2000) * 300) / 7, t_cal)
    x = rng.integers(0, 4, 2000).astype(float)
    rows = pnbd.Histories(x, t_x, t_cal)
    assert rows.t.size <= 4 * 300  # by the calendar; the rows have 2000 intervals
    columns = "x double, t_x double, t_cal double, weight bigint"
    data = spark.createDataFrame([(*map(float, v), 2) for v in zip(x, t_x, t_cal, strict=True)], columns)
    data = data.union(spark.createDataFrame([(None, 1.0, 2.0, 1)], columns))
    point = dict(zip(pnbd.PARAMETERS, map(float, params), strict=True))
    moved = {**point, "beta": point["beta"] * 1.01}
    value = fitting.weighted(lifetime.pnbd_log_likelihood, list(point), "weight")
    want = fitting.score_candidates(data, [point, moved], value).collect()
    got = fitting.score_pnbd(data, [point, moved]).collect()
    assert dict(map(tuple, got)) == pytest.approx(dict(map(tuple, want)), rel=1e-12)
