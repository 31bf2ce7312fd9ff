"""Queries for customer lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions import bgnbd, pnbd
from tillscope.operators import fitting, lifetime, newton
from tillscope.plans import pipelines
from tillscope.plans.registry import query, rounded
from tillscope.plans.views import CUTOFF, MAX_DAYS, quantile, sql
from tillscope.session import materialise
from tillscope.plans.test_tables import order_lines
from tillscope.sources.order_lines import VALUE

# Given parameters, so that SQL can check every formula without a fit.
BG = {"r": 2.5, "alpha": 60.0, "a": 0.6, "b": 9.0}
PARETO = {"r": 2.5, "alpha": 60.0, "s": 0.4, "beta": 90.0}
PARETO_SWAPPED = {"r": 1.8, "alpha": 75.0, "s": 0.7, "beta": 40.0}
SPEND = {"p": 6.137, "q": 12.41, "gamma": 301234.5}

HORIZON = lifetime.HORIZON_WEEKS
HISTOGRAM_TOP, HISTOGRAM_BINS = 3_000_000, 50
SPEND_WIDTH, SPEND_BINS = 25_000.0, 20

_CANDIDATES = {
    "bg": [BG, {**BG, "r": 3.0}, {**BG, "alpha": 80.0, "b": 4.0}, {**BG, "a": 1.4}],
    "pareto": [PARETO, PARETO_SWAPPED, {**PARETO, "s": 1.3}, {**PARETO, "beta": 60.0}],
    "spend": [SPEND, {**SPEND, "p": 4.5}, {**SPEND, "q": 9.0, "gamma": 250000.0}],
}


def _event_log(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date", VALUE])
    return lifetime.event_log(lines, CUTOFF, MAX_DAYS)


def _history(spark, root):
    return lifetime.purchase_history(_event_log(spark, root), CUTOFF)


# --- SQL forms of the model formulas -----------------------------------------


def _hyper(a: str, b: str, c: str, z: str, terms: int = 150) -> str:
    """The hypergeometric series in logs, for z > 0; one term where z = 0."""
    term = (
        f"exp(lgamma({a} + i) - lgamma({a}) + lgamma({b} + i) - lgamma({b}) "
        f"- lgamma({c} + i) + lgamma({c}) - lgamma(i + 1) + i * ln({z}))"
    )
    series = f"list_sum(list_transform(range({terms}), lambda i: {term}))"
    return f"(CASE WHEN {z} = 0 THEN 1 ELSE {series} END)"


def _values(name: str, sets: list[dict[str, float]]) -> str:
    rows = ", ".join(
        f"({i}, {', '.join(f'{v!r}::DOUBLE' for v in s.values())})" for i, s in enumerate(sets)
    )
    return f"SELECT * FROM (VALUES {rows}) AS {name}(candidate, {', '.join(sets[0])})"


_BG_LL = (
    "lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) "
    "- lgamma(a + b + x) + ln(pow(alpha + t_cal, -(r + x)) + CASE WHEN x > 0 THEN "
    "a / (b + x - 1) * pow(alpha + t_x, -(r + x)) ELSE 0 END)"
)

_BG_EXPECTED = (
    f"(a + b + x - 1) / (a - 1) * (1 - pow((alpha + t_cal) / (alpha + t_cal + {HORIZON}), r + x) * "
    + _hyper("(r + x)", "(b + x)", "(a + b + x - 1)", f"({HORIZON} / (alpha + t_cal + {HORIZON}))")
    + ") / (1 + CASE WHEN x > 0 THEN a / (b + x - 1) * "
    "pow((alpha + t_cal) / (alpha + t_x), r + x) ELSE 0 END)"
)


def _pareto_part(y: str) -> str:
    """A(y) of the Pareto/NBD likelihood."""
    total, top = "(r + s + x)", "greatest(alpha, beta)"
    second = "(CASE WHEN alpha >= beta THEN s + 1 ELSE r + x END)"
    series = _hyper(total, second, f"({total} + 1)", f"(abs(alpha - beta) / ({top} + {y}))")
    return f"({series} / pow({top} + {y}, {total}))"


_PARETO_GAP = f"({_pareto_part('t_x')} - {_pareto_part('t_cal')})"
_PARETO_LL = (
    "lgamma(r + x) - lgamma(r) + r * ln(alpha) + s * ln(beta) + ln(pow(alpha + t_cal, -(r + x)) * "
    f"pow(beta + t_cal, -s) + s / (r + s + x) * {_PARETO_GAP})"
)
_PARETO_EXPECTED = (
    f"1 / (1 + s / (r + s + x) * pow(alpha + t_cal, r + x) * pow(beta + t_cal, s) * {_PARETO_GAP}) "
    "* (r + x) * (beta + t_cal) / ((alpha + t_cal) * (s - 1)) "
    f"* (1 - pow((beta + t_cal) / (beta + t_cal + {HORIZON}), s - 1))"
)
_SPEND_LL = (
    "lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(gamma) + (p * x - 1) * ln(m_x) "
    "+ p * x * ln(x) - (p * x + q) * ln(gamma + m_x * x)"
)
_SPEND_EXPECTED = "p * (gamma + m_x * x) / (p * x + q - 1)"


def _pareto_pmf(k: int) -> str:
    top, gap = "greatest(alpha, beta)", "abs(alpha - beta)"
    second = f"(CASE WHEN alpha >= beta THEN s + 1 ELSE r + {k} END)"
    bottom = f"(r + s + {k} + 1)"
    past = " + ".join(
        f"exp(lgamma(r + s + {i}) - lgamma(r + s) - lgamma({i} + 1)) * pow(t_cal, {i}) * "
        + _hyper(f"(r + s + {i})", second, bottom, f"({gap} / ({top} + t_cal))")
        + f" / pow({top} + t_cal, r + s + {i})"
        for i in range(k + 1)
    )
    return (
        f"exp(lgamma(r + {k}) - lgamma(r) - lgamma({k} + 1)) * pow(alpha / (alpha + t_cal), r) * "
        f"pow(t_cal / (alpha + t_cal), {k}) * pow(beta / (beta + t_cal), s) + "
        f"pow(alpha, r) * pow(beta, s) * exp(lgamma(r + {k}) + lgamma(s + 1) - lgamma(r + s + {k} + 1)"
        " - lgamma(r) - lgamma(s) + lgamma(r + s)) * ("
        + _hyper("(r + s)", second, bottom, f"({gap} / {top})")
        + f" / pow({top}, r + s) - ({past}))"
    )


def _bg_pmf(k: int) -> str:
    def beta(u: str, v: str) -> str:
        return f"exp(lgamma({u}) + lgamma({v}) - lgamma({u} + {v}))"

    def count(j: int) -> str:
        return (
            f"exp(lgamma(r + {j}) - lgamma(r) - lgamma({j} + 1)) * pow(alpha / (alpha + t_cal), r) "
            f"* pow(t_cal / (alpha + t_cal), {j})"
        )

    stay = f"{beta('a', f'(b + {k})')} / {beta('a', 'b')} * {count(k)}"
    if k == 0:
        return stay
    reached = " + ".join(count(j) for j in range(k))
    return f"{stay} + {beta('(a + 1)', f'(b + {k} - 1)')} / {beta('a', 'b')} * (1 - ({reached}))"


def _frequency_sql(params: dict[str, float], pmf) -> str:
    """Actual and expected customers by repeat count, the last class open."""
    cap = lifetime.CENSOR
    actual = ", ".join(f"count(*) FILTER (x = {k}) AS a{k}" for k in range(cap))
    expected = ", ".join(f"sum(n * ({pmf(k)})) AS e{k}" for k in range(cap))
    seen = " - ".join(f"e{k}" for k in range(cap))
    rows = " UNION ALL ".join(
        [f"SELECT {k} AS repeats, a{k} AS actual, round(e{k}, 6) AS expected FROM w, e"
         for k in range(cap)]
        + [f"SELECT {cap}, n - {' - '.join(f'a{k}' for k in range(cap))}, round(n - {seen}, 6) FROM w, e"]
    )
    return sql(
        "cbs",
        f"SELECT CAST(repeats AS BIGINT) AS repeats, actual, expected FROM ({rows})",
        w=f"SELECT count(*) AS n, {actual} FROM cbs",
        spans="SELECT t_cal, count(*) AS n FROM cbs GROUP BY t_cal",
        params=_values("t", [params]),
        e=f"SELECT {expected} FROM spans CROSS JOIN params",
    )


def _likelihood_sql(kind: str, formula: str, where: str = "true") -> str:
    return sql(
        "cbs",
        "SELECT CAST(candidate AS BIGINT) AS candidate, round(sum(ll), 5) AS log_likelihood FROM "
        f"(SELECT candidate, {formula} AS ll FROM cbs CROSS JOIN candidates WHERE {where}) "
        "GROUP BY candidate",
        candidates=_values("t", _CANDIDATES[kind]),
    )


_SCORED = {
    "bg": _values("t", [BG]).replace("candidate", "one"),
    "pareto": _values("t", [PARETO]).replace("candidate", "one"),
    "spendp": _values("t", [SPEND]).replace("candidate", "one"),
    "scored": f"""
        SELECT c.cust, s.spend, p.y AS yearpred_pareto, b.y AS yearpred_bg,
               s.spend * p.y AS clv_pred_pareto, s.spend * b.y AS clv_pred_bg,
               coalesce(h.holdout_mean * h.holdout_count, 0) AS clv_real
        FROM cbs c
        JOIN (SELECT cust, {_SPEND_EXPECTED} AS spend FROM cbs CROSS JOIN spendp) s USING (cust)
        JOIN (SELECT cust, round({_PARETO_EXPECTED}, 2) AS y FROM cbs CROSS JOIN pareto) p
            USING (cust)
        JOIN (SELECT cust, round({_BG_EXPECTED}, 2) AS y FROM cbs CROSS JOIN bg) b USING (cust)
        LEFT JOIN holdout h USING (cust)""",
}


def _scored(spark, root):
    return pipelines.lifetime_values(
        order_lines(spark, root, ["customer_id", "date", VALUE]),
        CUTOFF,
        BG,
        PARETO,
        SPEND,
        MAX_DAYS,
    )


# --- event log and purchase history -----------------------------------------


@query(
    "clv_exclude_newcomers",
    sql("orderlines", "SELECT customer_id, order_id, product_id FROM orderlines WHERE customer_id "
        "NOT IN (SELECT customer_id FROM orderlines GROUP BY customer_id "
        f"HAVING min(date) >= DATE '{CUTOFF}')"),
)
def clv_exclude_newcomers(spark, root):
    lines = order_lines(spark, root, ["customer_id", "order_id", "product_id", "date"])
    kept = lifetime.exclude_newcomers(lines, CUTOFF)
    return kept.select("customer_id", "order_id", "product_id")


@query(
    "clv_event_log",
    sql("eventlog", "SELECT cust, CAST(date AS VARCHAR) AS date, round(sales, 4) AS sales "
        "FROM eventlog"),
)
def clv_event_log(spark, root):
    log = _event_log(spark, root).withColumn("date", F.col("date").cast("string"))
    return rounded(log, sales=4)


@query(
    "clv_cbs",
    sql("cbs", "SELECT cust, x, round(t_x, 8) AS t_x, round(t_cal, 8) AS t_cal FROM cbs"),
)
def clv_cbs(spark, root):
    return rounded(lifetime.cbs(_event_log(spark, root), CUTOFF), t_x=8, t_cal=8)


@query(
    "clv_cbt",
    sql("eventlog", "SELECT cust, CAST(date AS VARCHAR) AS date, count(*) AS purchases FROM "
        f"(SELECT *, min(date) OVER (PARTITION BY cust) AS f FROM eventlog WHERE date < DATE '{CUTOFF}') "
        "WHERE date > f GROUP BY ALL"),
)
def clv_cbt(spark, root):
    table = lifetime.cbt(_event_log(spark, root), CUTOFF)
    return table.withColumn("date", F.col("date").cast("string"))


@query(
    "clv_cbs_compressed",
    sql("cbs", "SELECT x, round(t_x, 8) AS t_x, round(t_cal, 8) AS t_cal, count(*) AS weight "
        "FROM cbs GROUP BY cbs.x, cbs.t_x, cbs.t_cal"),
)
def clv_cbs_compressed(spark, root):
    return rounded(lifetime.compress(_history(spark, root)), t_x=8, t_cal=8)


# --- likelihoods and fits ----------------------------------------------------


def _scores(data, kind, objective, weight):
    candidates = _CANDIDATES[kind]
    value = fitting.weighted(objective, list(candidates[0]), weight)
    found = fitting.score_candidates(data, candidates, value)
    return rounded(
        found.withColumn("candidate", F.col("candidate").cast("long")), log_likelihood=5
    )


@query("clv_bgnbd_loglik", _likelihood_sql("bg", _BG_LL))
def clv_bgnbd_loglik(spark, root):
    data = lifetime.compress(_history(spark, root))
    return _scores(data, "bg", lifetime.bgnbd_log_likelihood, "weight")


@query("clv_pnbd_loglik", _likelihood_sql("pareto", _PARETO_LL))
def clv_pnbd_loglik(spark, root):
    data = lifetime.compress(_history(spark, root))
    return _scores(data, "pareto", lifetime.pnbd_log_likelihood, "weight")


@query("clv_gg_loglik", _likelihood_sql("spend", _SPEND_LL, "x > 0"))
def clv_gg_loglik(spark, root):
    data = lifetime.repeat_buyers(_history(spark, root))
    return _scores(data, "spend", lifetime.spend_log_likelihood, None)


def _score_sql(params: dict, formula: str, rows: str) -> str:
    """Mean slope by the logarithm of each parameter, as a central difference of the formula."""
    parts = []
    for name in params:
        for side, sign in (("up", 1), ("down", -1)):
            moved = {**params, name: params[name] * (1 + sign * 1e-4)}
            values = ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in moved.items())
            parts.append(
                f"SELECT '{name}' AS parameter, '{side}' AS side, avg({formula}) AS ll "
                f"FROM {rows} CROSS JOIN (SELECT {values})"
            )
    return sql(
        "cbs",
        "SELECT parameter, round((max(ll) FILTER (side = 'up') - max(ll) FILTER (side = 'down')) "
        f"/ 2e-4, 5) AS slope FROM ({' UNION ALL '.join(parts)}) GROUP BY parameter",
    )


def _slopes(data, objective, derivatives, params, weight=None):
    """The score of one Newton round, per row and by log parameters."""
    names = F.array(*[F.lit(name) for name in params])
    scale = F.array(*[F.lit(float(v)) for v in params.values()])
    rows = data.agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double"))
    found = newton.sums(data, objective, derivatives, params, weight)
    return found.withColumn("_n", rows.scalar()).select(
        "_n", F.inline(F.arrays_zip(names.alias("parameter"), "score", scale.alias("scale")))
    ).select("parameter", F.round(F.col("score") * F.col("scale") / F.col("_n"), 5).alias("slope"))


@query("clv_bgnbd_score", _score_sql(BG, _BG_LL, "cbs"))
def clv_bgnbd_score(spark, root):
    data = lifetime.compress(_history(spark, root))
    return _slopes(data, lifetime.bgnbd_log_likelihood, newton.bgnbd_derivatives, BG, "weight")


@query("clv_gg_score", _score_sql(SPEND, _SPEND_LL, "(SELECT * FROM cbs WHERE x > 0)"))
def clv_gg_score(spark, root):
    data = lifetime.repeat_buyers(_history(spark, root))
    return _slopes(data, lifetime.spend_log_likelihood, newton.spend_derivatives, SPEND)


@query("clv_bgnbd_fit")
def clv_bgnbd_fit(spark, root):
    return fitting.fit_bgnbd(_history(spark, root))


@query("clv_pnbd_fit")
def clv_pnbd_fit(spark, root):
    return fitting.fit_pnbd(_history(spark, root))


@query("clv_gg_fit")
def clv_gg_fit(spark, root):
    return fitting.fit_spend(_history(spark, root))


# --- model checks --------------------------------------------------------------


@query("clv_freq_fit_bgnbd", _frequency_sql(BG, _bg_pmf))
def clv_freq_fit_bgnbd(spark, root):
    return rounded(lifetime.frequency_fit(_history(spark, root), BG, bgnbd), expected=6)


@query("clv_freq_fit_pnbd", _frequency_sql(PARETO, _pareto_pmf))
def clv_freq_fit_pnbd(spark, root):
    return rounded(lifetime.frequency_fit(_history(spark, root), PARETO, pnbd), expected=6)


@query(
    "clv_gamma_input",
    sql("cbs", "SELECT cust, x, round(m_x, 8) AS m_x FROM cbs WHERE x > 0"),
)
def clv_gamma_input(spark, root):
    return rounded(lifetime.repeat_buyers(_history(spark, root)), m_x=8)


@query(
    "clv_spend_distribution",
    sql(
        "cbs",
        f"SELECT bin, bin * {SPEND_WIDTH}::DOUBLE AS from_value, coalesce(any_value(c.n), 0) AS actual, "
        f"round(1e6 * sum(w.n * exp({_SPEND_LL})) / sum(w.n), 8) AS expected_per_million "
        f"FROM (SELECT bin, (bin + 0.5) * {SPEND_WIDTH}::DOUBLE AS m_x FROM range({SPEND_BINS}) t(bin)) b "
        "CROSS JOIN w CROSS JOIN spendp LEFT JOIN cells c ON c.cell = b.bin GROUP BY bin",
        spendp=_SCORED["spendp"],
        w="SELECT x, count(*) AS n FROM cbs WHERE x > 0 GROUP BY x",
        cells=f"SELECT least(CAST(floor(m_x / {SPEND_WIDTH}) AS BIGINT), {SPEND_BINS - 1}) AS cell, "
        "count(*) AS n FROM cbs WHERE x > 0 GROUP BY cell",
    ),
)
def clv_spend_distribution(spark, root):
    table = lifetime.spend_distribution(_history(spark, root), SPEND, SPEND_WIDTH, SPEND_BINS)
    return table.select(
        "bin",
        "from_value",
        "actual",
        F.round(F.col("expected_density") * 1e6, 8).alias("expected_per_million"),
    )


@query(
    "clv_spend_density",
    sql(
        "cbs",
        "SELECT point, round(value, 6) AS value, round(1e6 * sum(w * exp(-0.5 * "
        "pow((value - low - node * step) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 7) "
        "AS per_million FROM (SELECT point, low + point * (high - low) / 63 AS value, low, step, h, n "
        "FROM range(64) t(point) CROSS JOIN spread) CROSS JOIN nodes GROUP BY point, value",
        spread="SELECT min(m_x) AS low, max(m_x) AS high, (max(m_x) - min(m_x)) / 512 AS step, "
        "1.06 * stddev_samp(m_x) * pow(count(*), -0.2) AS h, count(*) AS n FROM cbs WHERE x > 0",
        cells="SELECT (m_x - low) / step AS place, least(CAST(floor((m_x - low) / step) AS BIGINT), 511) "
        "AS node FROM cbs CROSS JOIN spread WHERE x > 0",
        nodes="SELECT node, sum(w) AS w FROM (SELECT node, 1 - (place - node) AS w FROM cells "
        "UNION ALL SELECT node + 1, place - node FROM cells) GROUP BY node",
    ),
)
def clv_spend_density(spark, root):
    """The smoothed curve of observed mean sales."""
    curve = lifetime.spend_density(_history(spark, root))
    return curve.select(
        "point", F.round("value", 6).alias("value"), F.round(F.col("density") * 1e6, 7).alias("per_million")
    )


_MEANS = "list(m_x ORDER BY m_x)"


@query(
    "clv_independence",
    sql("cbs", "SELECT least(x, 7) AS repeats, count(*) AS n, round(min(m_x), 6) AS min, "
        + ", ".join(f"round({quantile(_MEANS, p)}, 5) AS {name}"
                    for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
        + ", round(max(m_x), 6) AS max FROM cbs WHERE x > 0 GROUP BY least(x, 7)")
    .replace("round(min(m_x), 6)", "round(min(m_x), 8)")
    .replace("round(max(m_x), 6)", "round(max(m_x), 8)"),
)
def clv_independence(spark, root):
    summary = lifetime.spend_by_repeats(_history(spark, root))
    return rounded(summary, min=8, q1=5, median=5, q3=5, max=8)


# --- prediction and evaluation ---------------------------------------------


@query(
    "clv_bgnbd_predict",
    sql("cbs", f"SELECT cust, round({_BG_EXPECTED}, 2) AS yearpred_bg FROM cbs CROSS JOIN bg",
        bg=_SCORED["bg"]),
)
def clv_bgnbd_predict(spark, root):
    predicted = lifetime.predict_purchases(_history(spark, root), BG, bgnbd, "yearpred_bg")
    return predicted.select("cust", "yearpred_bg")


@query(
    "clv_pnbd_predict",
    sql("cbs", f"SELECT cust, round({_PARETO_EXPECTED}, 2) AS yearpred_pareto FROM cbs "
        "CROSS JOIN pareto", pareto=_SCORED["pareto"]),
)
def clv_pnbd_predict(spark, root):
    predicted = lifetime.predict_purchases(_history(spark, root), PARETO, pnbd, "yearpred_pareto")
    return predicted.select("cust", "yearpred_pareto")


@query(
    "clv_spend_predict",
    sql("cbs", f"SELECT cust, round({_SPEND_EXPECTED}, 6) AS spend FROM cbs CROSS JOIN spendp",
        spendp=_SCORED["spendp"]),
)
def clv_spend_predict(spark, root):
    predicted = lifetime.predict_spend(_history(spark, root), SPEND)
    return rounded(predicted.select("cust", "spend"), spend=6)


@query(
    "clv_holdout_actuals",
    sql("holdout", "SELECT cust, round(holdout_mean, 8) AS holdout_mean, holdout_count FROM holdout"),
)
def clv_holdout_actuals(spark, root):
    return rounded(lifetime.holdout_actuals(_event_log(spark, root), CUTOFF), holdout_mean=8)


_SCORE_COLUMNS = (
    "SELECT cust, round(spend, 6) AS spend, yearpred_pareto, yearpred_bg, "
    "round(clv_pred_pareto, 4) AS clv_pred_pareto, round(clv_pred_bg, 4) AS clv_pred_bg, "
    "round(clv_real, 4) AS clv_real FROM scored"
)


@query("clv_score", sql("cbs holdout", _SCORE_COLUMNS, **_SCORED))
def clv_score(spark, root):
    """The score from its parts: separate aggregates, joined as left joins."""
    log = materialise(_event_log(spark, root))
    history = lifetime.cbs(log, CUTOFF).join(lifetime.mean_spend(log, CUTOFF), "cust")
    history = history.join(lifetime.holdout_actuals(log, CUTOFF), "cust", "left")
    scored = lifetime.score(history, BG, PARETO, SPEND)
    return rounded(scored, spend=6, clv_pred_pareto=4, clv_pred_bg=4, clv_real=4)


@query(
    "clv_eval",
    sql(
        "cbs holdout",
        " UNION ALL ".join(
            f"SELECT '{name}' AS model, round(sqrt(avg(pow(clv_real - {c}, 2))), 2) AS rmse, "
            f"round(avg(abs(clv_real - {c})), 2) AS mae FROM scored"
            for name, c in lifetime.MODELS.items()
        ),
        **_SCORED,
    ),
)
def clv_eval(spark, root):
    return lifetime.evaluate(_scored(spark, root))


_BUCKET = (
    f"CASE WHEN v = {HISTOGRAM_TOP} THEN {HISTOGRAM_BINS} WHEN v < 0 THEN 0 "
    f"WHEN v > {HISTOGRAM_TOP} THEN {HISTOGRAM_BINS + 1} "
    f"ELSE CAST(floor(v * {HISTOGRAM_BINS} / {HISTOGRAM_TOP}) AS BIGINT) + 1 END"
)


@query(
    "clv_histogram",
    sql(
        "cbs holdout",
        f"SELECT series, CAST({_BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS series, {c} AS v FROM scored"
            for c in ("clv_real", "clv_pred_pareto")
        )
        + ") GROUP BY ALL",
        **_SCORED,
    ),
)
def clv_histogram(spark, root):
    series = ["clv_real", "clv_pred_pareto"]
    return lifetime.histogram(
        _scored(spark, root).select(series), series, 0.0, float(HISTOGRAM_TOP), HISTOGRAM_BINS
    )


@query("clv_pipeline", sql("cbs holdout", _SCORE_COLUMNS, **_SCORED))
def clv_pipeline(spark, root):
    """The score in one scan and two shuffles."""
    return rounded(
        _scored(spark, root), spend=6, clv_pred_pareto=4, clv_pred_bg=4, clv_real=4
    )


@query("clv_pipeline_fitted")
def clv_pipeline_fitted(spark, root):
    """The score with fitted parameters, summed up per model."""
    lines = order_lines(spark, root, ["customer_id", "date", VALUE])
    scored = pipelines.fitted_lifetime_values(lines, CUTOFF, MAX_DAYS)
    return lifetime.evaluate(materialise(scored))
