"""Cleaning, ordering, quantiles and sources on small tables."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import cleaning, ordering, profiling
from tillscope.operators.quantiles import exact_quantiles
from tillscope.session import scratch_path
from tillscope.sources.basket_text import read_basket_text, write_basket_text
from tillscope.sources.order_lines import RAW_ORDER_LINE_SCHEMA, VALUE, read_order_lines

RAW = [
    # date, order, customer, product, title, zip, group, category, value
    ("5.3.2024", "o1", "c1", "p1", "sheet", "10", "Bed linen", "sheets", 10.0),
    ("05.03.2024", "o1", "c1", "p2", "towel", "10", "Bath", "towels", 0.0),
    ("x", "o2", "c2", "p1", "sheet", "20", "Bed Linen", "sheets", 5.0),
    ("06.03.2024", "o3", "c2", None, "lamp", "20", "Light", "lamps", 7.0),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, RAW_ORDER_LINE_SCHEMA)


def test_dates_parse_leniently(raw):
    dates = [r[0] for r in raw.select(cleaning.parse_date("date")).collect()]
    assert dates == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), None, dt.date(2024, 3, 6)]


def test_clean_fixes_labels_and_drops_rows(raw):
    rows = cleaning.clean_order_lines(raw).collect()
    assert [(r["order_id"], r["product_group_level_1"]) for r in rows] == [
        ("o1", "Bed Linen"),
        ("o2", "Bed Linen"),
    ]
    unfixed = cleaning.clean_order_lines(raw, None).collect()
    assert unfixed[0]["product_group_level_1"] == "Bed linen"


def test_basket_cleaning_keeps_values_and_old_group(raw):
    rows = {r["product_id"]: r for r in cleaning.clean_for_baskets(raw).collect() if r["date"]}
    assert rows["p2"]["price"] == 0.0
    assert rows["p1"]["product_group"] == "Bed linen"
    assert rows["p1"]["product_group_level_1"] == "Bed Linen"
    assert len(cleaning.clean_for_baskets(raw).columns) == 14


def test_label_table_equals_label_mapping(spark, raw):
    fixes = spark.createDataFrame([("Bed linen", "Bed Linen")], "wrong string, right string")
    by_table = cleaning.fix_labels_from(raw, cleaning.GROUP, fixes)
    assert sorted(by_table.select(cleaning.GROUP).collect()) == sorted(
        cleaning.fix_labels(raw, cleaning.GROUP).select(cleaning.GROUP).collect()
    )


def test_missing_counts(raw):
    assert profiling.missing_total(raw).first()[0] == 1
    profile = {r["column"]: r for r in profiling.missing_profile(raw).collect()}
    assert profile["product_id"]["missing"] == 1
    assert profile["product_id"]["share"] == 0.25
    assert profile[VALUE]["missing"] == 0


def test_csv_round_trip(spark, raw):
    path = scratch_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    back = read_order_lines(spark, path, "csv", raw=True)
    assert sorted(back.collect(), key=str) == sorted(raw.collect(), key=str)


def test_basket_text_splits_commas_only_in_text(spark):
    baskets = spark.createDataFrame(
        [("1", ["x12,5cm"]), ("2", ["a", "b"])], "order_id string, items array<string>"
    )
    path = scratch_path(spark, "text")
    write_basket_text(baskets, path)
    back = sorted(r["items"] for r in read_basket_text(spark, path).collect())
    assert back == [["5cm", "x12"], ["a", "b"]]


def test_factor_codes_are_ranks_of_sorted_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    codes = {r["v"]: r["v_code"] for r in cleaning.factor_codes(df, ["v"]).collect()}
    assert codes == {"a": 1, "b": 2, "c": 3, None: None}


def test_row_index_and_running_ratio(spark):
    values = [(i, float(v)) for i, v in enumerate([1, 2, 3, 6])]
    df = spark.createDataFrame(values, "i int, v double").repartition(3)
    ratios = {r["i"]: r["ratio"] for r in ordering.running_prior_ratio(df, ["i"], "v").collect()}
    assert ratios == {0: 1.0, 1: 2.0, 2: 1.0, 3: 1.0}
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert ordering.row_index(many, ["k"]).where("k + 1 != row_id").count() == 0


def test_sample_takes_the_smallest_hashes(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    for n in (0, 1, 7, 500, 3000, 5000):
        want = sorted((str(i) for i in range(3000)), key=lambda k: hashlib.md5(f"{k}#5".encode()).hexdigest())
        got = {r["k"] for r in ordering.sample_n(df, n, "k", seed=5).collect()}
        assert got == set(want[:n])


@pytest.mark.parametrize("shape", ["normal", "tied", "tiny", "skewed"])
def test_quantiles_equal_numpy(spark, shape):
    rng = random.Random(3)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(40_000)],
        "tied": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(20_000)],
        "tiny": [5.0, 1.0, 4.0],
        "skewed": [10.0 ** rng.uniform(-3, 9) for _ in range(30_000)],
    }[shape]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.5)], "g string, v double")
    probabilities = [0.0, 0.2, 0.25, 0.5, 0.77, 1.0]
    for few in (True, False):
        rows = {
            r["g"]: r for r in exact_quantiles(df, ["v"], probabilities, ["g"], few).collect()
        }
        assert rows["g"]["n"] == len(values)
        np.testing.assert_allclose(
            rows["g"]["quantiles"], np.quantile(values, probabilities), rtol=1e-13
        )
        assert rows["h"]["quantiles"] == [1.5] * 6
