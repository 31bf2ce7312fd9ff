"""Customer lifetime value: event log, purchase history, prediction, evaluation.

Times are in weeks. The calibration period ends the day before ``cutoff``.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import bgnbd, gamma_gamma, pnbd
from tillscope.functions.special import as_column
from tillscope.operators.quantiles import exact_quantiles, quantile_columns
from tillscope.sources.order_lines import VALUE

# Customers with this many purchase days or more are left out,
# predictions look this many weeks ahead, repeat counts are capped here.
MAX_TRANSACTIONS = 101
HORIZON_WEEKS = 52
CENSOR = 7
DAYS_PER_WEEK = 7


def _day(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def first_purchases(lines: DataFrame) -> DataFrame:
    return lines.groupBy("customer_id").agg(F.min("date").alias("first_date"))


def newcomers(lines: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Customers whose first purchase is at or after the cutoff."""
    return first_purchases(lines).where(F.col("first_date") >= _day(cutoff))


def exclude_newcomers(lines: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Lines without those of newcomers, for use on its own.

    ``event_log`` applies the same rule after grouping, without joining lines.
    """
    return lines.join(newcomers(lines, cutoff), "customer_id", "left_anti")


def merge_same_day(lines: DataFrame, value: str = VALUE) -> DataFrame:
    """One row ``(cust, date, sales)`` per customer and day."""
    return lines.groupBy(F.col("customer_id").alias("cust"), "date").agg(
        F.sum(value).alias("sales")
    )


def event_log(
    lines: DataFrame,
    cutoff: dt.date | str,
    max_transactions: int = MAX_TRANSACTIONS,
    value: str = VALUE,
) -> DataFrame:
    """Customer-days of customers who are no newcomers and have few enough days.

    Lines are summed per customer and day before anything else. A customer then
    has at most one row per calendar day, so the window over a customer is
    bounded, and the later grouping by customer needs no further shuffle.
    """
    per_customer = Window.partitionBy("cust")
    return (
        merge_same_day(lines, value)
        .withColumn("_first", F.min("date").over(per_customer))
        .withColumn("_days", F.count(F.lit(1)).over(per_customer))
        .where((F.col("_first") < _day(cutoff)) & (F.col("_days") < max_transactions))
        .select("cust", "date", "sales")
    )


def purchase_history(log: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Everything the models need per customer, from one grouping of the log.

    ``x`` repeat days, ``t_x`` weeks from first to last, ``t_cal`` weeks from first
    to the end of calibration, ``m_x`` mean sale, and hold-out mean and count.
    """
    inside = F.col("date") < _day(cutoff)
    first = F.min(F.when(inside, F.col("date")))
    last = F.max(F.when(inside, F.col("date")))
    cal_end = F.date_sub(_day(cutoff), 1)
    return (
        log.groupBy("cust")
        .agg(
            F.count_if(inside).alias("_days"),
            first.alias("_first"),
            last.alias("_last"),
            F.avg(F.when(inside, F.col("sales"))).alias("m_x"),
            F.avg(F.when(~inside, F.col("sales"))).alias("holdout_mean"),
            F.count_if(~inside).alias("holdout_count"),
        )
        .where("_days > 0")
        .select(
            "cust",
            (F.col("_days") - 1).alias("x"),
            (F.date_diff("_last", "_first") / DAYS_PER_WEEK).alias("t_x"),
            (F.date_diff(cal_end, F.col("_first")) / DAYS_PER_WEEK).alias("t_cal"),
            "m_x",
            "holdout_mean",
            "holdout_count",
        )
    )


def cbs(log: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Repeat count, recency and observation time per customer: ``(cust, x, t_x, t_cal)``."""
    return purchase_history(log, cutoff).select("cust", "x", "t_x", "t_cal")


def cbt(log: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Repeat purchases per customer and day of the calibration period, long form."""
    first = F.min("date").over(Window.partitionBy("cust"))
    return (
        log.where(F.col("date") < _day(cutoff))
        .withColumn("_first", first)
        .where(F.col("date") > F.col("_first"))
        .groupBy("cust", "date")
        .agg(F.count(F.lit(1)).alias("purchases"))
    )


def compress(history: DataFrame) -> DataFrame:
    """Distinct ``(x, t_x, t_cal)`` with the number of customers as weight.

    A likelihood needs no more. Times are whole days, so the table is bounded by
    the calendar and the largest count, not by the number of customers.
    """
    return history.groupBy("x", "t_x", "t_cal").agg(F.count(F.lit(1)).alias("weight"))


def columns_of(params: Mapping[str, float | Column]) -> dict[str, Column]:
    """Model parameters as columns."""
    return {name: as_column(value) for name, value in params.items()}


def _history() -> tuple[Column, Column, Column]:
    return F.col("x").cast("double"), F.col("t_x"), F.col("t_cal")


def bgnbd_log_likelihood(params: Mapping[str, float | Column]) -> Column:
    return bgnbd.log_likelihood(columns_of(params), *_history())


def pnbd_log_likelihood(params: Mapping[str, float | Column]) -> Column:
    return pnbd.log_likelihood(columns_of(params), *_history())


def spend_log_likelihood(params: Mapping[str, float | Column]) -> Column:
    return gamma_gamma.log_likelihood(columns_of(params), F.col("m_x"), F.col("x").cast("double"))


def frequency_fit(
    history: DataFrame, params: Mapping[str, float], model=bgnbd, censor: int = CENSOR
) -> DataFrame:
    """Actual and expected customers by repeat count; the last class is open.

    The probabilities depend on a customer only through ``t_cal``, so they are
    computed once per distinct value of it (bounded by the calendar).
    """
    values = columns_of(params)
    spans = history.groupBy("t_cal").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("x") == k).alias(f"_actual_{k}") for k in range(censor)],
    )
    expected = spans.withColumns(
        {f"_pmf_{k}": model.pmf(values, k, F.col("t_cal")) for k in range(censor)}
    )
    totals = expected.agg(
        F.sum("_n").alias("_n"),
        *[F.sum(f"_actual_{k}").alias(f"_actual_{k}") for k in range(censor)],
        *[F.sum(F.col("_n") * F.col(f"_pmf_{k}")).alias(f"_pmf_{k}") for k in range(censor)],
    )

    def rest(prefix: str) -> Column:
        seen = [F.col(f"{prefix}_{k}") for k in range(censor)]
        return F.col("_n") - sum(seen[1:], seen[0])

    classes = [
        (k, F.col(f"_actual_{k}"), F.col(f"_pmf_{k}")) for k in range(censor)
    ] + [(censor, rest("_actual"), rest("_pmf"))]
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).cast("long").alias("repeats"),
                        actual.cast("long").alias("actual"),
                        share.cast("double").alias("expected"),
                    )
                    for k, actual, share in classes
                ]
            )
        )
    )


def mean_spend(log: DataFrame, cutoff: dt.date | str, holdout: bool = False) -> DataFrame:
    """Mean sale per customer in the calibration or the hold-out period."""
    day = _day(cutoff)
    chosen = F.col("date") >= day if holdout else F.col("date") < day
    return log.where(chosen).groupBy("cust").agg(F.avg("sales").alias("m_x"))


def holdout_actuals(log: DataFrame, cutoff: dt.date | str) -> DataFrame:
    """Mean sale and number of purchase days per customer after the cutoff."""
    return (
        log.where(F.col("date") >= _day(cutoff))
        .groupBy("cust")
        .agg(F.avg("sales").alias("holdout_mean"), F.count(F.lit(1)).alias("holdout_count"))
    )


def repeat_buyers(history: DataFrame) -> DataFrame:
    """Input of the spend model: customers with at least one repeat purchase."""
    return history.where("x > 0").select("cust", "x", "m_x")


def spend_distribution(
    history: DataFrame, params: Mapping[str, float], width: float, bins: int
) -> DataFrame:
    """Actual customers and expected share per bin of the mean sale.

    The last bin is open. The model density at the bin centre is averaged over
    the repeat counts, of which there are few; the bins are generated from them.
    """
    values = columns_of(params)
    buyers = repeat_buyers(history)
    cell = F.least(F.floor(F.col("m_x") / width), F.lit(bins - 1)).cast("long")
    cells = buyers.groupBy("x", cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    actual = cells.groupBy("bin").agg(F.sum("n").alias("actual"))
    counts = cells.groupBy("x").agg(F.sum("n").alias("n"))
    grid = counts.select(
        F.col("x").cast("double").alias("x"),
        "n",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"),
    ).withColumn("m_x", (F.col("bin") + 0.5) * width)
    density = F.exp(gamma_gamma.log_likelihood(values, F.col("m_x"), F.col("x")))
    expected = grid.groupBy("bin").agg(
        (F.sum(F.col("n") * density) / F.sum("n")).alias("expected_density")
    )
    return expected.join(actual, "bin", "left").select(
        "bin",
        (F.col("bin") * width).alias("from_value"),
        F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
        "expected_density",
    )


def spend_density(history: DataFrame, points: int = 64, cells: int = 512) -> DataFrame:
    """Smoothed density of the mean sale of repeat buyers, at even points of its range.

    A Gaussian kernel with Silverman's bandwidth, 1.06 sd n^(-1/5). Values are first
    shared out linearly between the two nearest of ``cells + 1`` grid nodes, so one
    aggregation with at most that many rows holds all customers, and the kernel runs
    over nodes. Returns point, value and density; no rows without two different
    values.
    """
    buyers = repeat_buyers(history).select(F.col("m_x").cast("double").alias("m_x"))
    moments = buyers.agg(
        F.struct(
            F.min("m_x").alias("low"),
            F.max("m_x").alias("high"),
            (1.06 * F.stddev_samp("m_x") * F.pow(F.count("m_x"), F.lit(-0.2))).alias("h"),
        ).alias("m")
    )
    step = (F.col("m.high") - F.col("m.low")) / cells
    at = (F.col("m_x") - F.col("m.low")) / step
    node = F.least(F.floor(at), F.lit(cells - 1)).cast("long")
    shared = (
        buyers.withColumn("m", moments.scalar())
        .where(F.col("m.high") > F.col("m.low"))
        .select(node.alias("node"), (at - node).alias("right"))
    )
    nodes = (
        shared.select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), (1 - F.col("right")).alias("w")),
                    F.struct((F.col("node") + 1).alias("node"), F.col("right").alias("w")),
                )
            ).alias("e")
        )
        .groupBy("e.node")
        .agg(F.sum("e.w").alias("w"))
    )
    whole = nodes.agg(F.collect_list(F.struct("node", "w")).alias("nodes")).where(
        F.size("nodes") > 0
    )  # at most cells + 1 entries
    value = F.col("m.low") + F.col("point") * (F.col("m.high") - F.col("m.low")) / (points - 1)

    def weighed(e: Column) -> Column:
        away = (F.col("value") - F.col("m.low") - e["node"] * step) / F.col("m.h")
        return e["w"] * F.exp(-0.5 * away * away)

    total = F.aggregate("nodes", F.lit(0.0), lambda s, e: s + e["w"])
    kernel = F.aggregate(F.transform("nodes", weighed), F.lit(0.0), lambda s, v: s + v)
    return (
        whole.withColumn("m", moments.scalar())
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)).cast("array<bigint>")))
        .withColumn("value", value)
        .select(
            "point", "value", (kernel / (total * F.col("m.h") * math.sqrt(2 * math.pi))).alias("density")
        )
    )


def spend_by_repeats(history: DataFrame, cap: int = CENSOR) -> DataFrame:
    """Five-number summary of mean sale by capped repeat count."""
    capped = repeat_buyers(history).withColumn("repeats", F.least("x", F.lit(cap)))
    summary = exact_quantiles(capped, ["m_x"], [0.0, 0.25, 0.5, 0.75, 1.0], by=["repeats"], few_groups=True)
    return quantile_columns(summary, ["min", "q1", "median", "q3", "max"]).drop("variable")


def spend_repeat_correlation(history: DataFrame, cap: int = CENSOR) -> DataFrame:
    """Correlation of mean sale and capped repeat count."""
    return repeat_buyers(history).agg(
        F.corr("m_x", F.least("x", F.lit(cap)).cast("double")).alias("correlation")
    )


def predict_purchases(
    history: DataFrame,
    params: Mapping[str, float],
    model=bgnbd,
    name: str = "yearpred_bg",
    horizon_weeks: float = HORIZON_WEEKS,
    digits: int = 2,
) -> DataFrame:
    """Add the rounded number of purchases expected in the coming weeks."""
    expected = model.expected_purchases(
        columns_of(params), *_history(), F.lit(float(horizon_weeks))
    )
    return history.withColumn(name, F.round(expected, digits))


def predict_spend(history: DataFrame, params: Mapping[str, float]) -> DataFrame:
    """Add the expected spend per purchase, also for customers without repeats."""
    spend = gamma_gamma.expected_spend(columns_of(params), F.col("m_x"), F.col("x").cast("double"))
    return history.withColumn("spend", spend)


def score(
    history: DataFrame,
    bgnbd_params: Mapping[str, float],
    pnbd_params: Mapping[str, float],
    spend_params: Mapping[str, float],
    horizon_weeks: float = HORIZON_WEEKS,
) -> DataFrame:
    """Predicted and real value per customer.

    Missing hold-out values count as 0; a prediction that the parameters do not
    define stays null. Predictions cover ``horizon_weeks``, the real value
    only the hold-out period, which may be shorter; pass its length to compare
    like with like.
    """
    predicted = predict_purchases(
        history, pnbd_params, pnbd, "yearpred_pareto", horizon_weeks
    )
    predicted = predict_purchases(
        predicted, bgnbd_params, bgnbd, "yearpred_bg", horizon_weeks
    ).transform(predict_spend, spend_params)
    filled = predicted.select(
        "cust", "spend", "yearpred_pareto", "yearpred_bg", "holdout_mean", "holdout_count"
    ).fillna(0, ["holdout_mean", "holdout_count"])
    return filled.select(
        "cust",
        "spend",
        "yearpred_pareto",
        "yearpred_bg",
        (F.col("spend") * F.col("yearpred_pareto")).alias("clv_pred_pareto"),
        (F.col("spend") * F.col("yearpred_bg")).alias("clv_pred_bg"),
        (F.col("holdout_mean") * F.col("holdout_count")).alias("clv_real"),
    )


# Model names in reports, and their prediction columns.
MODELS = {"Pareto/NBD": "clv_pred_pareto", "BG/NBD": "clv_pred_bg"}


def evaluate(scored: DataFrame, models: Mapping[str, str] = MODELS, digits: int = 2) -> DataFrame:
    """Root mean squared and mean absolute error per model, from one pass."""
    errors = {name: F.col("clv_real") - F.col(column) for name, column in models.items()}
    parts = []
    for i, error in enumerate(errors.values()):
        parts += [
            F.sqrt(F.avg(error * error)).alias(f"rmse_{i}"),
            F.avg(F.abs(error)).alias(f"mae_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("model"),
            F.round(f"rmse_{i}", digits).alias("rmse"),
            F.round(f"mae_{i}", digits).alias("mae"),
        )
        for i, name in enumerate(errors)
    ]
    return scored.agg(*parts).select(F.inline(F.array(*rows)))


def histogram(
    df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 7000.0, bins: int = 50
) -> DataFrame:
    """Counts per equal bin of every column as ``(series, bucket, n)``.

    Buckets 1..bins cover [low, high]; ``high`` itself belongs to the last one.
    Bucket 0 and bins + 1 hold what lies outside, so no row is lost.
    """
    long = df.unpivot([], list(columns), "series", "value").where("value IS NOT NULL")
    bucket = F.when(F.col("value") == high, F.lit(bins)).otherwise(
        F.width_bucket("value", F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    )
    return long.groupBy("series", bucket.cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
