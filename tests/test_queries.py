"""Every query against its SQL on the small tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillroll.plans.oracles import ORACLES
from tillroll.plans.queries import QUERIES
from tests.compare import difference, duck
from tests.conftest import TINY, rows
from tillroll.operators import checks
from tillroll.plans.ledger import Ledger


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, TINY, name) is None


@pytest.mark.parametrize("name", [
    "order_ids", "fifo_deliveries", "stock_levels", "middle_customer", "credit_data", "balances", "customers_by_name",
    "json_decode", "duration_stats", "check_payment_delta", "gen_orders", "modification_log", "order_lines", "home_stock_joined",
    "drawn_orders",
])
def test_query_equals_sql_with_hot_keys_split(spark, con, name):
    spark.conf.set("tillroll.hotRows", "300" if name == "fifo_deliveries" else "6")
    try:
        assert difference(spark, con, TINY, name) is None
    finally:
        spark.conf.unset("tillroll.hotRows")


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_rules_hold_on_the_tables(spark):
    for name in [n for n in QUERIES if n.startswith("check_")]:
        checked = entry.queries()[name](spark, TINY)
        assert checked.count() > 0
        assert checks.violations(checked).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_on_the_jvm_and_in_keyed_windows(spark, name):
    text = plan(entry.queries()[name](spark, TINY))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert word not in text, word


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["order_ids"](spark, TINY))
    scans = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans and all("[l_orderkey#" in s and "l_quantity" not in s for s in scans)
    text = plan(entry.queries()["payments"](spark, TINY))
    assert "EqualTo(event_type,purchase)" in text


def test_as_of_the_end_is_the_whole_log(spark):
    x = Ledger(spark, TINY)
    last = x.district_log.agg(F.max("ts")).first()[0]
    from tillroll.operators import logs

    assert logs.as_of(x.district_log, last).count() == x.district_log.count()
    some = logs.as_of(x.log_orders, 883612800000).select("txn")
    early = x.accepted.where("ts <= 883612800000").select("txn")
    assert rows(some, "txn") == rows(early, "txn")


def test_views_rebuild_from_the_modification_log_alone(spark):
    x = Ledger(spark, TINY)
    log = x.modifications.groupBy("type").agg(F.count("*").alias("n"))
    counted = dict(rows(log, "type", "n"))
    assert counted["neworder"] == x.accepted.count()
    assert counted["neworder-line"] == x.unnumbered_lines.count()
    assert counted["remote-stock"] == x.unnumbered_lines.where("supply_w <> w").count()
    assert x.modifications.where("type = 'payment' and customer_data is not null").count() == x.credit_data.count()


def test_stock_table_has_each_part_in_each_warehouse(spark):
    x = Ledger(spark, TINY)
    assert x.opening_stock.count() == x.shop.rows("part") * x.shop.rows("nation")
