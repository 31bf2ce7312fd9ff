"""Queries for sources, projections, filters, joins, aggregates and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.operators import baskets, cleaning, lifetime, ordering, profiling, rankings
from tillscope.operators.clustering import FEATURES, cluster_base
from tillscope.plans.registry import query, rounded
from tillscope.plans.views import ANALYSIS_DATE, CUTOFF, ITEM_SUPPORT, MAX_DAYS, sql
from tillscope.session import materialise, scratch_path
from tillscope.sources.basket_text import read_basket_text, write_basket_text
from tillscope.plans.test_tables import order_lines, raw_order_lines
from tillscope.sources.order_lines import COLUMNS, VALUE, table

# The label fixes of the dirty view: lower-case group labels and their right form.
GROUP_FIXES = {
    "economy": "ECONOMY",
    "large": "LARGE",
    "medium": "MEDIUM",
    "promo": "PROMO",
    "small": "SMALL",
    "standard": "STANDARD",
}

_TEXT_COLUMNS = ", ".join(c for c in COLUMNS if c not in ("date", VALUE))


def _as_text(df, column="date"):
    return df.withColumn(column, F.col(column).cast("string"))


def _customers(spark, root):
    lines = order_lines(spark, root, ["customer_id", "order_id", "date", VALUE])
    return cluster_base(lines, ANALYSIS_DATE)


def _event_log(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date", VALUE])
    return lifetime.event_log(lines, CUTOFF, MAX_DAYS)


def _history(spark, root):
    return lifetime.purchase_history(_event_log(spark, root), CUTOFF)


# --- sources and sinks -------------------------------------------------------


@query(
    "src_orderlines",
    sql("orderlines", f"SELECT CAST(date AS VARCHAR) AS date, {_TEXT_COLUMNS}, "
        f"round({VALUE}, 4) AS {VALUE} FROM orderlines"),
)
def src_orderlines(spark, root):
    return rounded(_as_text(order_lines(spark, root)), **{VALUE: 4})


@query(
    "src_schema_profile",
    sql(
        "orderlines",
        "SELECT CAST(position AS BIGINT) AS position, name, type, "
        "(SELECT count(*) FROM orderlines) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM (VALUES "
        + ", ".join(
            f"({i}, '{c}', '{ {'date': 'date', VALUE: 'double'}.get(c, 'string') }')"
            for i, c in enumerate(COLUMNS, start=1)
        )
        + ") AS t(position, name, type)",
    ),
)
def src_schema_profile(spark, root):
    return profiling.schema_profile(order_lines(spark, root))


def _written_baskets(spark, root):
    path = scratch_path(spark, "baskets")
    lines = order_lines(spark, root, ["order_id", "product_title"])
    write_basket_text(baskets.collect_baskets(lines), path)
    return path


@query(
    "sink_basket_csv",
    sql("items", "SELECT string_agg(item, ',' ORDER BY item) AS line FROM items GROUP BY order_id"),
)
def sink_basket_csv(spark, root):
    return spark.read.text(_written_baskets(spark, root)).select(F.col("value").alias("line"))


@query(
    "src_basket_csv",
    sql(
        "items",
        "SELECT string_agg(item, '|' ORDER BY item) AS items, count(*) AS size "
        "FROM items GROUP BY order_id",
    ),
)
def src_basket_csv(spark, root):
    read = read_basket_text(spark, _written_baskets(spark, root))
    return read.select(
        F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("size")
    )


# --- projections and scalar functions ---------------------------------------


@query(
    "proj_select",
    sql("orderlines", f"SELECT customer_id, CAST(date AS VARCHAR) AS date, "
        f"round({VALUE}, 4) AS {VALUE} FROM orderlines"),
)
def proj_select(spark, root):
    lines = order_lines(spark, root).select("customer_id", "date", VALUE)
    return rounded(_as_text(lines), **{VALUE: 4})


@query(
    "proj_rename",
    sql("orderlines", f"SELECT customer_id AS cust, CAST(date AS VARCHAR) AS order_date, "
        f"round({VALUE}, 4) AS revenue FROM orderlines"),
)
def proj_rename(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date", VALUE]).withColumnsRenamed(
        {"customer_id": "cust", "date": "order_date", VALUE: "revenue"}
    )
    return rounded(_as_text(lines, "order_date"), revenue=4)


@query(
    "proj_drop",
    sql("items", "SELECT string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY order_id"),
)
def proj_drop(spark, root):
    found = baskets.collect_baskets(order_lines(spark, root, ["order_id", "product_title"]))
    return found.drop("order_id").withColumn("items", F.array_join("items", ","))


@query(
    "proj_derive",
    sql(
        "orderlines",
        f"SELECT order_id, product_id, round({VALUE}, 4) AS price, product_title AS product, "
        "customer_zip_code AS zip_code, product_group_level_1 AS product_group, "
        "product_category_level_2 AS product_category FROM orderlines",
    ),
)
def proj_derive(spark, root):
    derived = order_lines(spark, root).withColumns(
        {
            "price": F.col(VALUE),
            "product": F.col("product_title"),
            "zip_code": F.col("customer_zip_code"),
            "product_group": F.col("product_group_level_1"),
            "product_category": F.col("product_category_level_2"),
        }
    )
    kept = ["price", "product", "zip_code", "product_group", "product_category"]
    return rounded(derived.select("order_id", "product_id", *kept), price=4)


@query(
    "cast_text",
    "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, "
    "CAST(l_linenumber AS VARCHAR) AS line FROM lineitem",
)
def cast_text(spark, root):
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_linenumber").cast("string").alias("line"),
    )


@query(
    "cast_numeric",
    "SELECT l_orderkey AS order_key, l_linenumber AS line, TRY_CAST(CASE WHEN l_linenumber = 7 "
    "THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) AS price FROM lineitem",
)
def cast_numeric(spark, root):
    text = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(
        F.col("l_extendedprice").cast("string")
    )
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        cleaning.to_number(text).alias("price"),
    )


@query(
    "cast_factor",
    sql(
        "orderlines",
        "SELECT l.product_id, l.product_group_level_1, g.code AS product_group_level_1_code, "
        "l.product_category_level_2, c.code AS product_category_level_2_code FROM orderlines l "
        "JOIN g ON g.v = l.product_group_level_1 JOIN c ON c.v = l.product_category_level_2",
        g="SELECT v, row_number() OVER (ORDER BY v) AS code FROM "
        "(SELECT DISTINCT product_group_level_1 AS v FROM orderlines)",
        c="SELECT v, row_number() OVER (ORDER BY v) AS code FROM "
        "(SELECT DISTINCT product_category_level_2 AS v FROM orderlines)",
    ),
)
def cast_factor(spark, root):
    names = ["product_group_level_1", "product_category_level_2"]
    return cleaning.factor_codes(order_lines(spark, root, ["product_id", *names]), names)


@query(
    "date_parse",
    sql("orderlines_raw", "SELECT order_id, product_id, date AS text, "
        "CAST(CAST(try_strptime(translate(date, '-/', '..'), '%d.%m.%Y') AS DATE) AS VARCHAR) AS date FROM orderlines_raw"),
)
def date_parse(spark, root):
    raw = raw_order_lines(spark, root, ["order_id", "product_id", "date"])
    return _as_text(raw.withColumn("text", F.col("date")).withColumn(
        "date", cleaning.parse_date("date")
    ))


@query(
    "date_literal",
    sql("orderlines", f"SELECT order_id, product_id, date_diff('day', date, DATE '{ANALYSIS_DATE}') "
        f"AS days_to_analysis, CAST(DATE '{ANALYSIS_DATE}' AS VARCHAR) AS analysis_date "
        "FROM orderlines"),
)
def date_literal(spark, root):
    day = F.lit(ANALYSIS_DATE).cast("date")
    return order_lines(spark, root, ["order_id", "product_id", "date"]).select(
        "order_id",
        "product_id",
        F.date_diff(day, "date").cast("long").alias("days_to_analysis"),
        day.cast("string").alias("analysis_date"),
    )


@query(
    "label_fix",
    sql("orderlines_raw", "SELECT product_id, upper(product_group_level_1) AS "
        "product_group_level_1 FROM orderlines_raw"),
)
def label_fix(spark, root):
    raw = raw_order_lines(spark, root, ["product_id", "product_group_level_1"])
    return cleaning.fix_labels(raw, cleaning.GROUP, GROUP_FIXES)


@query("scalar_cap", sql("cbs", "SELECT cust, least(x, 7) AS repeats FROM cbs"))
def scalar_cap(spark, root):
    return _history(spark, root).select("cust", F.least("x", F.lit(7)).alias("repeats"))


@query(
    "scalar_round",
    sql("customers", "SELECT customer_id, round(monetary / frequency / 7, 2) AS two, "
        "round(monetary / frequency / 7, 3) AS three, round(sqrt(monetary), 4) AS four, "
        "round(frequency / monetary, 6) AS six FROM customers"),
)
def scalar_round(spark, root):
    mean = F.col("monetary") / F.col("frequency") / 7
    return _customers(spark, root).select(
        "customer_id",
        F.round(mean, 2).alias("two"),
        F.round(mean, 3).alias("three"),
        F.round(F.sqrt("monetary"), 4).alias("four"),
        F.round(F.col("frequency") / F.col("monetary"), 6).alias("six"),
    )


@query(
    "scalar_math",
    sql("customers", "SELECT customer_id, round(sqrt(monetary), 6) AS root, frequency * frequency "
        "AS square, round(monetary * frequency, 4) AS product, "
        "round(sqrt(monetary) / nullif(recency, 0), 6) AS per_day FROM customers"),
)
def scalar_math(spark, root):
    return _customers(spark, root).select(
        "customer_id",
        F.round(F.sqrt("monetary"), 6).alias("root"),
        (F.col("frequency") * F.col("frequency")).alias("square"),
        F.round(F.col("monetary") * F.col("frequency"), 4).alias("product"),
        F.round(F.try_divide(F.sqrt("monetary"), "recency"), 6).alias("per_day"),
    )


@query(
    "null_to_zero",
    sql("cbs holdout", "SELECT c.cust, coalesce(round(h.holdout_mean, 8), 0) AS holdout_mean, "
        "coalesce(h.holdout_count, 0) AS holdout_count FROM cbs c LEFT JOIN holdout h "
        "ON h.cust = c.cust"),
)
def null_to_zero(spark, root):
    history = _history(spark, root).select("cust", "holdout_mean", "holdout_count")
    return rounded(history.fillna(0), holdout_mean=8)


@query(
    "row_index",
    sql("customers", "SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS row_id "
        "FROM customers"),
)
def row_index(spark, root):
    ids = order_lines(spark, root, ["customer_id"]).distinct()
    return ordering.row_index(ids, ["customer_id"])


@query(
    "str_collapse",
    sql("orderlines", "SELECT order_id, string_agg(product_title, ',' ORDER BY product_title) "
        "AS items FROM orderlines GROUP BY order_id"),
)
def str_collapse(spark, root):
    return baskets.collapse_items(order_lines(spark, root, ["order_id", "product_title"]))


# --- filters -----------------------------------------------------------------


@query(
    "filter_complete",
    sql("complete", f"SELECT date, {_TEXT_COLUMNS}, round({VALUE}, 4) AS {VALUE} FROM complete"),
)
def filter_complete(spark, root):
    return rounded(cleaning.drop_incomplete(raw_order_lines(spark, root)), **{VALUE: 4})


@query(
    "filter_positive",
    sql("orderlines_raw", f"SELECT order_id, product_id, round({VALUE}, 4) AS {VALUE} "
        f"FROM orderlines_raw WHERE {VALUE} > 0"),
)
def filter_positive(spark, root):
    raw = raw_order_lines(spark, root, ["order_id", "product_id", VALUE])
    return rounded(cleaning.keep_positive(raw), **{VALUE: 4})


@query(
    "filter_date_range",
    sql("orderlines", f"SELECT customer_id, order_id, CAST(date AS VARCHAR) AS date, "
        f"date >= DATE '{CUTOFF}' AS holdout FROM orderlines "
        f"WHERE date >= DATE '1997-01-01' AND date < DATE '2000-01-01'"),
)
def filter_date_range(spark, root):
    lines = order_lines(spark, root, ["customer_id", "order_id", "date"])
    inside = lines.where("date >= DATE '1997-01-01' AND date < DATE '2000-01-01'")
    flagged = inside.withColumn("holdout", F.col("date") >= F.lit(CUTOFF).cast("date"))
    return _as_text(flagged)


@query(
    "filter_having",
    sql("sameday", f"SELECT cust, count(*) AS n FROM sameday GROUP BY cust "
        f"HAVING count(*) < {MAX_DAYS}"),
)
def filter_having(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date"])
    days = lines.select(F.col("customer_id").alias("cust"), "date").distinct()
    return days.groupBy("cust").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MAX_DAYS)


@query(
    "filter_repeat_buyers",
    sql("cbs", "SELECT cust, x, round(m_x, 8) AS m_x FROM cbs WHERE x > 0"),
)
def filter_repeat_buyers(spark, root):
    return rounded(lifetime.repeat_buyers(_history(spark, root)), m_x=8)


@query(
    "clean_pipeline",
    sql("complete", "SELECT CAST(CAST(strptime(translate(date, '-/', '..'), '%d.%m.%Y') AS DATE) AS VARCHAR) AS date, "
        "order_id, customer_id, product_id, product_title, customer_zip_code, "
        "upper(product_group_level_1) AS product_group_level_1, product_category_level_2, "
        f"round({VALUE}, 4) AS {VALUE} FROM complete WHERE {VALUE} > 0"),
)
def clean_pipeline(spark, root):
    cleaned = cleaning.clean_order_lines(raw_order_lines(spark, root), GROUP_FIXES)
    return rounded(_as_text(cleaned), **{VALUE: 4})


@query(
    "clean_pipeline_basket",
    sql("complete", "SELECT CAST(CAST(strptime(translate(date, '-/', '..'), '%d.%m.%Y') AS DATE) AS VARCHAR) AS date, "
        "order_id, customer_id, product_id, product_title, customer_zip_code, "
        "upper(product_group_level_1) AS product_group_level_1, product_category_level_2, "
        f"round({VALUE}, 4) AS {VALUE}, round({VALUE}, 4) AS price, product_title AS product, "
        "customer_zip_code AS zip_code, product_group_level_1 AS product_group, "
        "product_category_level_2 AS product_category FROM complete"),
)
def clean_pipeline_basket(spark, root):
    cleaned = cleaning.clean_for_baskets(raw_order_lines(spark, root), GROUP_FIXES)
    return rounded(_as_text(cleaned), **{VALUE: 4, "price": 4})


# --- joins -------------------------------------------------------------------


@query(
    "join_inner",
    sql("cbs", "SELECT cust, x, round(t_x, 6) AS t_x, round(t_cal, 6) AS t_cal, "
        "round(m_x, 8) AS m_x FROM cbs"),
)
def join_inner(spark, root):
    log = _event_log(spark, root)
    joined = lifetime.cbs(log, CUTOFF).join(lifetime.mean_spend(log, CUTOFF), "cust")
    return rounded(joined, t_x=6, t_cal=6, m_x=8)


@query(
    "join_left_chain",
    sql("cbs holdout", "SELECT c.cust, c.x, round(c.m_x, 8) AS m_x, round(h.holdout_mean, 8) AS "
        "holdout_mean, coalesce(h.holdout_count, 0) AS holdout_count, round(k.t_cal, 6) AS t_cal "
        "FROM cbs c LEFT JOIN holdout h ON h.cust = c.cust LEFT JOIN cbs k ON k.cust = c.cust"),
)
def join_left_chain(spark, root):
    log = materialise(_event_log(spark, root))
    actual = lifetime.holdout_actuals(log, CUTOFF)
    base = lifetime.cbs(log, CUTOFF).select("cust", "x")
    joined = (
        base.join(lifetime.mean_spend(log, CUTOFF), "cust", "left")
        .join(actual, "cust", "left")
        .join(lifetime.cbs(log, CUTOFF).select("cust", "t_cal"), "cust", "left")
        .fillna(0, ["holdout_count"])
    )
    return rounded(joined, m_x=8, holdout_mean=8, t_cal=6)


@query(
    "join_semi",
    sql("sameday", f"SELECT cust, CAST(date AS VARCHAR) AS date, round(sales, 4) AS sales FROM "
        f"sameday WHERE cust IN (SELECT cust FROM sameday GROUP BY cust HAVING count(*) < {MAX_DAYS})"),
)
def join_semi(spark, root):
    days = lifetime.merge_same_day(order_lines(spark, root, ["customer_id", "date", VALUE]))
    few = days.groupBy("cust").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MAX_DAYS)
    return rounded(_as_text(days.join(few, "cust", "left_semi")), sales=4)


@query(
    "join_anti",
    sql("orderlines", f"SELECT customer_id, order_id, CAST(date AS VARCHAR) AS date FROM orderlines "
        "WHERE customer_id NOT IN (SELECT customer_id FROM orderlines GROUP BY customer_id "
        f"HAVING min(date) >= DATE '{CUTOFF}')"),
)
def join_anti(spark, root):
    lines = order_lines(spark, root, ["customer_id", "order_id", "date"])
    return _as_text(lifetime.exclude_newcomers(lines, CUTOFF)).select(
        "customer_id", "order_id", "date"
    )


@query(
    "join_cooccurrence",
    sql("items", "SELECT a.item AS item_a, b.item AS item_b, count(*) AS count FROM items a "
        "JOIN items b ON a.order_id = b.order_id AND a.item < b.item GROUP BY ALL "
        f"HAVING count(*) >= (SELECT ceil({ITEM_SUPPORT} * count(DISTINCT order_id)) FROM items)"),
)
def join_cooccurrence(spark, root):
    pairs = baskets.order_items(order_lines(spark, root, ["order_id", "product_title"]))
    return baskets.cooccurring_pairs(pairs, ITEM_SUPPORT)


# --- aggregates --------------------------------------------------------------


@query(
    "agg_missing_total",
    sql("orderlines_raw", "SELECT CAST(sum(CAST(product_title IS NULL AS INT) + "
        "CAST(customer_zip_code IS NULL AS INT)) AS BIGINT) AS missing_cells FROM orderlines_raw"),
)
def agg_missing_total(spark, root):
    return profiling.missing_total(raw_order_lines(spark, root))


@query(
    "agg_missing_profile",
    sql("orderlines_raw", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) / count(*), 8) AS share FROM orderlines_raw"
        for c in COLUMNS
    )),
)
def agg_missing_profile(spark, root):
    return rounded(profiling.missing_profile(raw_order_lines(spark, root)), share=8)


@query(
    "agg_summary_numeric",
    sql("orderlines", f"SELECT 'value' AS variable, round(min({VALUE}), 4) AS min, "
        f"round(quantile_cont({VALUE}, 0.25), 4) AS q1, round(median({VALUE}), 4) AS median, "
        f"round(avg({VALUE}), 4) AS mean, round(quantile_cont({VALUE}, 0.75), 4) AS q3, "
        f"round(max({VALUE}), 4) AS max FROM orderlines UNION ALL "
        "SELECT 'days', min(d), quantile_cont(d, 0.25), median(d), round(avg(d), 4), "
        "quantile_cont(d, 0.75), max(d) FROM (SELECT CAST(date_diff('day', date, "
        f"DATE '{ANALYSIS_DATE}') AS DOUBLE) AS d FROM orderlines)"),
)
def agg_summary_numeric(spark, root):
    lines = order_lines(spark, root, ["date", VALUE]).select(
        F.col(VALUE).alias("value"),
        F.date_diff(F.lit(ANALYSIS_DATE).cast("date"), "date").alias("days"),
    )
    summary = profiling.numeric_summary(lines, ["value", "days"])
    return rounded(summary, min=4, q1=4, median=4, mean=4, q3=4, max=4)


@query(
    "agg_summary_factor",
    sql("orderlines", " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS level, count(*) AS n FROM orderlines GROUP BY {c}"
        for c in ("product_group_level_1", "product_category_level_2", "customer_zip_code")
    )),
)
def agg_summary_factor(spark, root):
    names = ["product_group_level_1", "product_category_level_2", "customer_zip_code"]
    return profiling.factor_summary(order_lines(spark, root, names), names)


@query(
    "agg_top_customers",
    sql("orderlines", f"SELECT customer_id, round(sum({VALUE}), 4) AS total_spend FROM orderlines "
        "GROUP BY customer_id ORDER BY total_spend DESC, customer_id LIMIT 10"),
)
def agg_top_customers(spark, root):
    lines = order_lines(spark, root, ["customer_id", VALUE])
    return rounded(rankings.top_customers(lines), total_spend=4)


@query(
    "agg_top_products",
    sql("orderlines", f"SELECT product_title, round(sum({VALUE}), 4) AS total_revenue FROM "
        "orderlines GROUP BY product_title ORDER BY total_revenue DESC, product_title LIMIT 10"),
)
def agg_top_products(spark, root):
    lines = order_lines(spark, root, ["product_title", VALUE])
    return rounded(rankings.top_products(lines), total_revenue=4)


@query(
    "agg_top_categories",
    sql("orderlines", f"SELECT product_group_level_1, round(sum({VALUE}), 4) AS total_revenue FROM "
        "orderlines GROUP BY product_group_level_1 ORDER BY total_revenue DESC LIMIT 10"),
)
def agg_top_categories(spark, root):
    lines = order_lines(spark, root, ["product_group_level_1", VALUE])
    return rounded(rankings.top_categories(lines), total_revenue=4)


@query(
    "agg_basket_collect",
    sql("items", "SELECT order_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS size "
        "FROM items GROUP BY order_id"),
)
def agg_basket_collect(spark, root):
    found = baskets.collect_baskets(order_lines(spark, root, ["order_id", "product_title"]))
    return found.select(
        "order_id",
        F.array_join("items", ",").alias("items"),
        F.size("items").cast("long").alias("size"),
    )


@query(
    "agg_basket_summary",
    sql(
        "items",
        """SELECT metric, round(value, 8) AS value FROM (
        SELECT 'baskets' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sizes
        UNION ALL SELECT 'items', count(*) FROM freq
        UNION ALL SELECT 'density', sum(s) / count(*) / (SELECT count(*) FROM freq) FROM sizes
        UNION ALL SELECT 'size_min', min(s) FROM sizes
        UNION ALL SELECT 'size_q1', quantile_cont(s, 0.25) FROM sizes
        UNION ALL SELECT 'size_median', median(s) FROM sizes
        UNION ALL SELECT 'size_mean', avg(s) FROM sizes
        UNION ALL SELECT 'size_q3', quantile_cont(s, 0.75) FROM sizes
        UNION ALL SELECT 'size_max', max(s) FROM sizes
        UNION ALL SELECT 'size=' || s, count(*) FROM sizes GROUP BY s
        UNION ALL SELECT * FROM
            (SELECT 'item=' || item, n FROM freq ORDER BY n DESC, item LIMIT 5))""",
        sizes="SELECT order_id, count(*) AS s FROM items GROUP BY order_id",
        freq="SELECT item, count(*) AS n FROM items GROUP BY item",
    ),
)
def agg_basket_summary(spark, root):
    pairs = baskets.order_items(order_lines(spark, root, ["order_id", "product_title"]))
    return rounded(baskets.basket_summary(pairs), value=8)


@query(
    "agg_customer_cluster_base",
    sql("customers", "SELECT customer_id, recency, frequency, round(monetary, 4) AS monetary "
        "FROM customers"),
)
def agg_customer_cluster_base(spark, root):
    return rounded(_customers(spark, root), monetary=4)


@query(
    "agg_first_purchase",
    sql("orderlines", "SELECT customer_id, CAST(min(date) AS VARCHAR) AS first_date, "
        f"min(date) >= DATE '{CUTOFF}' AS newcomer FROM orderlines GROUP BY customer_id"),
)
def agg_first_purchase(spark, root):
    first = lifetime.first_purchases(order_lines(spark, root, ["customer_id", "date"]))
    flagged = first.withColumn("newcomer", F.col("first_date") >= F.lit(CUTOFF).cast("date"))
    return _as_text(flagged, "first_date")


@query(
    "agg_merge_same_day",
    sql("sameday", "SELECT cust, CAST(date AS VARCHAR) AS date, round(sales, 4) AS sales FROM sameday"),
)
def agg_merge_same_day(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date", VALUE])
    return rounded(_as_text(lifetime.merge_same_day(lines)), sales=4)


@query("agg_count", sql("sameday", "SELECT cust, count(*) AS n FROM sameday GROUP BY cust"))
def agg_count(spark, root):
    lines = order_lines(spark, root, ["customer_id", "date"])
    days = lines.select(F.col("customer_id").alias("cust"), "date").distinct()
    return days.groupBy("cust").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_mean_spend",
    sql("cbs holdout", "SELECT cust, 'calibration' AS period, round(m_x, 8) AS m_x FROM cbs "
        "UNION ALL SELECT cust, 'holdout', round(holdout_mean, 8) FROM holdout"),
)
def agg_mean_spend(spark, root):
    log = _event_log(spark, root)
    before = lifetime.mean_spend(log, CUTOFF).withColumn("period", F.lit("calibration"))
    after = lifetime.mean_spend(log, CUTOFF, holdout=True).withColumn("period", F.lit("holdout"))
    return rounded(before.unionByName(after), m_x=8)


@query(
    "agg_col_means",
    sql("customers", "SELECT round(avg(recency), 6) AS recency, round(avg(frequency), 6) AS "
        "frequency, round(avg(monetary), 4) AS monetary FROM customers"),
)
def agg_col_means(spark, root):
    means = profiling.column_means(_customers(spark, root), FEATURES)
    return rounded(means, recency=6, frequency=6, monetary=4)


@query(
    "agg_corr_matrix",
    sql("customers", " UNION ALL ".join(
        f"SELECT '{a}' AS \"row\", '{b}' AS col, round(corr({a}, {b}), 8) AS r FROM customers"
        for a in FEATURES for b in FEATURES
    )),
)
def agg_corr_matrix(spark, root):
    return rounded(profiling.correlation_matrix(_customers(spark, root), FEATURES), r=8)


@query(
    "agg_corr_pair",
    sql("cbs", "SELECT round(corr(m_x, least(x, 7)), 8) AS correlation FROM cbs WHERE x > 0"),
)
def agg_corr_pair(spark, root):
    return rounded(lifetime.spend_repeat_correlation(_history(spark, root)), correlation=8)


# --- windows, order, limits, sets ---------------------------------------------


@query(
    "win_running_prior_sum",
    sql("customers", "SELECT customer_id, round(monetary / coalesce(sum(monetary) OVER (ORDER BY "
        "monetary, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 8) AS ratio "
        "FROM customers"),
)
def win_running_prior_sum(spark, root):
    values = _customers(spark, root).select("customer_id", "monetary")
    ratios = ordering.running_prior_ratio(values, ["monetary", "customer_id"], "monetary")
    return rounded(ratios, ratio=8).select("customer_id", "ratio")


@query(
    "win_row_number",
    sql("customers", "SELECT customer_id, frequency, row_number() OVER (ORDER BY frequency DESC, "
        "customer_id) AS position FROM customers"),
)
def win_row_number(spark, root):
    ranked = ordering.row_index(
        _customers(spark, root), [F.desc("frequency"), "customer_id"], name="position"
    )
    return ranked.select("customer_id", "frequency", "position")


@query(
    "sort_desc",
    sql("customers", "SELECT customer_id, frequency, round(monetary, 4) AS monetary FROM customers "
        "ORDER BY monetary DESC, customer_id"),
)
def sort_desc(spark, root):
    ranked = _customers(spark, root).orderBy(F.desc("monetary"), "customer_id")
    return rounded(ranked.select("customer_id", "frequency", "monetary"), monetary=4)


@query(
    "limit_head",
    sql("orderlines", f"SELECT order_id, product_id, round({VALUE}, 4) AS {VALUE} FROM orderlines "
        f"ORDER BY {VALUE} DESC, order_id, product_id LIMIT 6"),
)
def limit_head(spark, root):
    lines = order_lines(spark, root, ["order_id", "product_id", VALUE])
    return rounded(ordering.top_k(lines, 6, VALUE, "order_id", "product_id"), **{VALUE: 4})


@query(
    "limit_tail",
    sql("customers", "SELECT customer_id, round(monetary, 4) AS monetary FROM customers "
        "ORDER BY monetary, customer_id LIMIT 10"),
)
def limit_tail(spark, root):
    # The last ten of a falling order are the first ten of the rising one.
    last = _customers(spark, root).orderBy("monetary", "customer_id").limit(10)
    return rounded(last.select("customer_id", "monetary"), monetary=4)


@query(
    "sample_n",
    sql("customers", "SELECT customer_id, frequency FROM customers "
        "ORDER BY md5(customer_id || '#123'), customer_id LIMIT 500"),
)
def sample_n(spark, root):
    # Sampled from a materialised table: the sampler reads it three times.
    base = materialise(_customers(spark, root).select("customer_id", "frequency"))
    return ordering.sample_n(base, 500, "customer_id", seed=123)


@query(
    "set_union",
    sql("cbs holdout", "SELECT 'calibration' AS period, count(*) AS customers, "
        "round(avg(m_x), 4) AS mean_sale FROM cbs UNION ALL "
        "SELECT 'holdout', count(*), round(avg(holdout_mean), 4) FROM holdout"),
)
def set_union(spark, root):
    log = _event_log(spark, root)
    stacked = [
        lifetime.mean_spend(log, CUTOFF, holdout=late).agg(
            F.lit("holdout" if late else "calibration").alias("period"),
            F.count(F.lit(1)).alias("customers"),
            F.avg("m_x").alias("mean_sale"),
        )
        for late in (False, True)
    ]
    return rounded(stacked[0].unionByName(stacked[1]), mean_sale=4)


@query(
    "set_distinct",
    sql("orderlines", "SELECT DISTINCT product_group_level_1, product_category_level_2 FROM orderlines"),
)
def set_distinct(spark, root):
    names = ["product_group_level_1", "product_category_level_2"]
    return order_lines(spark, root, names).distinct()
