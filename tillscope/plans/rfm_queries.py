"""Queries for RFM scores and segments."""

from __future__ import annotations

from tillscope.operators import rfm
from tillscope.plans.pipelines import segment_customers
from tillscope.plans.registry import query, rounded
from tillscope.plans.views import ANALYSIS_DATE, quantile, sql
from tillscope.plans.test_tables import order_lines
from tillscope.sources.order_lines import VALUE

_SCORES = {"recency_days": "r", "transaction_count": "f", "amount": "m"}


def _passed(measure: str, short: str) -> str:
    return "(" + " + ".join(
        f"CAST(s.{measure} >= {quantile(f'c.{short}', i / 5)} AS INT)" for i in range(1, 5)
    ) + ")"


_BLOCKS = {
    "cuts": "SELECT " + ", ".join(
        f"list({measure} ORDER BY {measure}) AS {short}" for measure, short in _SCORES.items()
    ) + " FROM measures",
    "scored": f"""
        SELECT s.*, 5 - {_passed('recency_days', 'r')} AS recency_score,
               1 + {_passed('transaction_count', 'f')} AS frequency_score,
               1 + {_passed('amount', 'm')} AS monetary_score
        FROM measures s CROSS JOIN cuts c""",
    "segmented": "SELECT *, CASE "
    + " ".join(
        f"WHEN recency_score BETWEEN {s.recency[0]} AND {s.recency[1]} "
        f"AND frequency_score BETWEEN {s.frequency[0]} AND {s.frequency[1]} "
        f"AND monetary_score BETWEEN {s.monetary[0]} AND {s.monetary[1]} THEN '{s.name}'"
        for s in rfm.SEGMENTS
    )
    + f" ELSE '{rfm.OTHERS}' END AS segment FROM scored",
}


def _sql(final: str) -> str:
    return sql("measures", final, **_BLOCKS)


def _lines(spark, root):
    return order_lines(spark, root, ["customer_id", "date", VALUE])


@query(
    "rfm_table",
    _sql("SELECT customer_id, recency_days, transaction_count, round(amount, 4) AS amount, "
         "recency_score, frequency_score, monetary_score, "
         "100 * recency_score + 10 * frequency_score + monetary_score AS rfm_score FROM scored"),
)
def rfm_table(spark, root):
    return rounded(rfm.rfm_table(_lines(spark, root), ANALYSIS_DATE), amount=4)


@query(
    "rfm_segment",
    _sql("SELECT customer_id, segment, 100 * recency_score + 10 * frequency_score + "
         "monetary_score AS rfm_score FROM segmented"),
)
def rfm_segment(spark, root):
    segmented = segment_customers(_lines(spark, root), ANALYSIS_DATE)
    return segmented.select("customer_id", "segment", "rfm_score")


@query(
    "rfm_segment_summary",
    _sql("SELECT segment, count(*) AS customers, CAST(sum(transaction_count) AS BIGINT) AS orders, "
         "round(sum(amount), 4) AS revenue, round(sum(amount) / sum(transaction_count), 6) AS aov "
         "FROM segmented GROUP BY segment"),
)
def rfm_segment_summary(spark, root):
    segmented = segment_customers(_lines(spark, root), ANALYSIS_DATE)
    return rounded(rfm.segment_summary(segmented), revenue=4, aov=6)


@query(
    "rfm_segment_medians",
    _sql("SELECT segment, median(recency_days) AS median_recency_days, median(transaction_count) "
         "AS median_transaction_count, round(median(amount), 5) AS median_amount "
         "FROM segmented GROUP BY segment"),
)
def rfm_segment_medians(spark, root):
    segmented = segment_customers(_lines(spark, root), ANALYSIS_DATE)
    return rounded(rfm.segment_medians(segmented), median_amount=5)


@query(
    "rfm_heatmap",
    _sql("SELECT recency_score, frequency_score, round(avg(amount), 4) AS mean_amount "
         "FROM scored GROUP BY recency_score, frequency_score"),
)
def rfm_heatmap(spark, root):
    scored = rfm.rfm_table(_lines(spark, root), ANALYSIS_DATE)
    return rounded(rfm.score_heatmap(scored), mean_amount=4)


@query(
    "rfm_score_distribution",
    _sql("SELECT recency_score, frequency_score, monetary_score, count(*) AS customers "
         "FROM scored GROUP BY recency_score, frequency_score, monetary_score"),
)
def rfm_score_distribution(spark, root):
    return rfm.score_distribution(rfm.rfm_table(_lines(spark, root), ANALYSIS_DATE))
