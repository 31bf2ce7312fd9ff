"""Every named query against its SQL check, on small test tables."""

import pytest
from compare import check, connect

from tillscope.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connections(data):
    return {data: connect(data)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connections, data, name):
    good, note = check(spark, connections[data], data, name)
    assert good, note


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_iterative_queries_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "clu_ward_clusters",
        "clu_ward_gain",
        "clu_ward_profile",
        "clu_ward_tree",
        "clv_bgnbd_fit",
        "clv_gg_fit",
        "clv_pipeline_fitted",
        "clv_pnbd_fit",
    }


def test_keys_of_the_test_tables_hold(spark, data):
    """The order-line view may skip joins that only check a key."""
    from tillscope.sources.order_lines import order_lines

    for columns in (["order_id"], ["customer_id"], ["product_title"]):
        trusted = order_lines(spark, data, columns, rely_on_keys=True)
        checked = order_lines(spark, data, columns)
        assert trusted.exceptAll(checked).isEmpty()
        assert checked.exceptAll(trusted).isEmpty()
