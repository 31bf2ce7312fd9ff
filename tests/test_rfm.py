"""RFM scores and segments."""

import datetime as dt

from tillscope.operators import rfm


def test_tied_quantiles_leave_bins_empty(spark):
    rows = [(str(i), i, n, float(i)) for i, n in enumerate([1, 1, 1, 1, 9])]
    measures = spark.createDataFrame(
        rows, "customer_id string, recency_days long, transaction_count long, amount double"
    )
    scores = {
        r["transaction_count"]: r["frequency_score"] for r in rfm.score_measures(measures).collect()
    }
    assert scores == {1: 4, 9: 5}


def test_recent_customers_score_high(spark):
    rows = [(str(i), i, i, float(i)) for i in range(10)]
    measures = spark.createDataFrame(
        rows, "customer_id string, recency_days long, transaction_count long, amount double"
    )
    scored = {r["customer_id"]: r for r in rfm.score_measures(measures).collect()}
    assert scored["0"]["rfm_score"] == 511
    assert scored["9"]["rfm_score"] == 155


def test_segments_first_match_wins(spark):
    scores = [(5, 5, 5), (3, 3, 3), (2, 2, 2), (2, 2, 1), (5, 1, 1), (1, 5, 1)]
    df = spark.createDataFrame(scores, "recency_score int, frequency_score int, monetary_score int")
    found = [r["segment"] for r in rfm.assign_segments(df).collect()]
    assert found == ["Champions", "Loyal", "Potential", "Lost", "New", "Others"]


def test_at_risk_is_never_assigned(spark):
    every = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(every, "recency_score int, frequency_score int, monetary_score int")
    assert rfm.assign_segments(df).where("segment = 'At Risk'").isEmpty()


def test_grain_counts_lines_or_orders(spark):
    rows = [("c", "o1", dt.date(2024, 1, 1), 1.0)] * 2 + [("c", "o2", dt.date(2024, 1, 3), 2.0)]
    lines = spark.createDataFrame(
        rows, "customer_id string, order_id string, date date, revenue double"
    )
    by_line = rfm.rfm_measures(lines, "2024-01-05", "line", "revenue").first()
    by_order = rfm.rfm_measures(lines, "2024-01-05", "order", "revenue").first()
    assert (by_line["recency_days"], by_line["transaction_count"], by_line["amount"]) == (2, 3, 4.0)
    assert by_order["transaction_count"] == 2
