"""Worked examples of each transaction."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.operators import accounts, checks, customers, logs, orders, queue, relational, results, stock, verify, views

ITEMS = [(0, "zero", D("10.00")), (1, "one", D("11.11")), (2, "two", D("12.22"))]
ITEM = "item int, item_name string, price decimal(12,2)"
LINE = "txn int, line int, ts int, w int, d int, item int, supply_w int, quantity int"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, ITEM)


def test_accept_reject_and_empty_orders(spark, items):
    placed = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "txn int, w int")
    lines = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 1), (2, 99, 1)], "txn int, item int, quantity int")
    want = [(1, True), (2, False), (3, True)]
    assert rows(verify.approve(placed, lines, items), "txn", "approved") == want
    both = verify.approve_with_totals(placed, lines, items)
    assert rows(both.where("approved"), "txn", "n_lines", "total") == [(1, 2, D("53.33")), (3, 0, D("0.00"))]
    assert rows(verify.accept(placed, lines, items), "txn") == [(1,), (3,)]


def test_fan_out_names_each_warehouse_once(spark):
    placed = spark.createDataFrame([(1, 1)], "txn int, w int")
    lines = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (1, None), (9, 5)], "txn int, remote_w int")
    assert rows(verify.order_warehouses(placed, lines), "txn", "w") == [(1, 1), (1, 2), (1, 3)]


def test_types(spark):
    log = spark.createDataFrame([("payment", 1), ("delivery", 2), ("neworder", 3)], "type string, txn int")
    branches = verify.route(log)
    assert {k: rows(v, "txn") for k, v in branches.items()} == {"payment": [(1,)], "delivery": [(2,)], "neworder": [(3,)]}
    strange = log.union(spark.createDataFrame([("refund", 4)], "type string, txn int"))
    with pytest.raises(Exception, match="unknown transaction type refund"):
        verify.route(strange)["payment"].collect()
    approved = strange.select("txn", verify.approve_by_type(F.col("type"), F.lit(True)).alias("ok"))
    assert rows(approved, "txn", "ok") == [(1, True), (2, True), (3, True), (4, False)]


def test_remote_lines_look_at_home_stock_and_change_the_supplier(spark, items):
    # home 3; both lines come from 4
    lines = spark.createDataFrame([(1, 0, 1, 3, 1, 0, 4, 3), (1, 1, 1, 3, 1, 1, 4, 5)], LINE)
    start = spark.createDataFrame(
        [(3, 0, 50), (3, 1, 11), (4, 0, 60), (4, 1, 11)], "stock_w int, item int, start_level int"
    )
    moved = stock.with_levels(stock.movements(lines), start)
    assert rows(moved.where("role = 'look'"), "line", "stock_w", "level") == [(0, 3, 50), (1, 3, 11)]
    assert rows(moved.where("role = 'supply'"), "line", "stock_w", "level") == [(0, 4, 57), (1, 4, 97)]
    priced = orders.priced_lines(lines, items)
    assert rows(priced, "line", "amount") == [(0, D("30.00")), (1, D("55.55"))]
    placed = spark.createDataFrame([(1, 3, 1)], "txn int, w int, d int")
    assert rows(orders.summary(placed, priced), "amount", "n_lines", "all_local") == [(D("85.55"), 2, False)]


def test_supplier_side_levels(spark):
    # worker 3 supplies lines 0 and 1 of an order placed at 4
    lines = spark.createDataFrame(
        [(1, 0, 1, 4, 1, 0, 3, 3), (1, 1, 1, 4, 1, 1, 3, 5), (1, 2, 1, 4, 1, 2, 4, 7), (1, 3, 1, 4, 1, 2, 5, 9)], LINE
    )
    start = spark.createDataFrame([(3, 0, 50), (3, 1, 11)], "stock_w int, item int, start_level int")
    moved = stock.with_levels(stock.movements(lines), start).where("role = 'supply' and stock_w = 3")
    assert rows(moved, "line", "level") == [(0, 47), (1, 97)]


def test_order_ids_go_on_from_a_start(spark):
    placed = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 1, 6), (3, 2, 1, 6)], "txn int, w int, d int, ts int")
    assert rows(orders.number_orders(placed), "txn", "order_id") == [(1, 1), (2, 2), (3, 1)]
    start = spark.createDataFrame([(1, 1, 40)], "w int, d int, next_id int")
    assert rows(orders.number_orders(placed, start), "txn", "order_id") == [(1, 40), (2, 41), (3, 1)]


def test_delivery_takes_the_oldest_order_of_each_district(spark):
    placed = spark.createDataFrame(
        [(1, 3, 1, 11, 70, D("28.73")), (1, 3, 2, 12, 71, D("10.00")), (1, 5, 3, 13, 72, D("11.11"))],
        "w int, d int, ts int, txn int, c int, total decimal(22,2)",
    )
    delivery = spark.createDataFrame([(90, 5, 1, 4)], "txn int, ts int, w int, carrier int")
    log = queue.district_log(placed, delivery)
    done = queue.delivered(log)
    assert rows(done, "d", "order_id", "c", "total") == [(3, 1, 70, D("28.73")), (5, 1, 72, D("11.11"))]
    result = queue.delivery_results(delivery, done).first()
    assert result.orders == {3: 1, 5: 1}
    left = queue.pending(queue.numbered_orders(log), done)
    assert rows(left, "d", "order_id", "c") == [(3, 2, 71)]
    nothing = queue.delivery_results(delivery, done.where("false")).first()
    assert nothing.orders == {}


def test_balances(spark):
    paid = spark.createDataFrame([(1, 1, 7, 5, 100, D("67.89"))], "c_w int, c_d int, c int, ts int, txn int, amount decimal(12,2)")
    none = spark.createDataFrame([], "w int, d int, c int, ts int, txn int, total decimal(22,2)")
    start = spark.createDataFrame([(1, 1, 7, D("12.34"))], "w int, d int, c int, start_balance decimal(22,2)")
    changed = accounts.changes(paid, none)
    assert rows(accounts.with_balance(changed, start), "balance") == [(D("-55.55"),)]
    assert rows(accounts.current_balances(changed, start), "balance") == [(D("-55.55"),)]
    assert rows(accounts.current_balances(changed), "balance") == [(D("-77.89"),)]
    got = spark.createDataFrame([(1, 1, 7, 1, 1, D("28.73")), (1, 1, 8, 1, 1, D("11.11"))], none.schema)
    start = spark.createDataFrame([(1, 1, 7, D("5.55")), (1, 1, 8, D("-24.95"))], start.schema)
    changed = accounts.changes(paid.where("false"), got)
    assert rows(accounts.current_balances(changed, start), "c", "balance") == [(7, D("34.28")), (8, D("-13.84"))]


@pytest.mark.parametrize("names,event,sql", [("ABC", "B", "B"), ("ABCD", "C", "B"), ("A", "A", "A"), ("AB", "B", "A")])
def test_middle_customer(spark, names, event, sql):
    people = spark.createDataFrame([(1, 1, "X", n, i) for i, n in enumerate(names)], "w int, d int, last string, first string, c int")
    for variant, want in (("event", event), ("sql", sql)):
        got = customers.middle_customers(people, variant).first().c
        assert names[got] == want


def low_stock(spark, recent, levels, threshold, distinct=True):
    lines = spark.createDataFrame([(1, 1, i) for i in recent], "w int, d int, item int")
    at = spark.createDataFrame([(1, i, v) for i, v in levels.items()], "stock_w int, item int, level int")
    asked = spark.createDataFrame([(1, 1, threshold), (1, 2, threshold)], "w int, d int, threshold int")
    return dict(rows(stock.low_stock(lines, at, asked, distinct), "d", "low"))


def test_stock_level(spark):
    thirty = {i: i for i in range(10, 40)}
    assert low_stock(spark, thirty, thirty, 25) == {1: 15, 2: 0}
    twice = [1, 2, 1, 2]
    assert low_stock(spark, twice, {1: 10, 2: 10}, 15) == {1: 2, 2: 0}
    assert low_stock(spark, twice, {1: 10, 2: 10}, 15, distinct=False) == {1: 4, 2: 0}


def test_newest_twenty_orders(spark):
    numbered = spark.createDataFrame([(1, 1, i) for i in range(1, 31)], "w int, d int, order_id int")
    assert [r[0] for r in rows(orders.recent_orders(numbered), "order_id")] == list(range(11, 31))
    lines = [(o * 5 + k, o) for o in range(11, 31) for k in range(5)]
    assert low_stock(spark, [i for i, _ in lines], dict(lines), 25) == {1: 70, 2: 0}


def test_order_status(spark):
    placed = spark.createDataFrame(
        [(1, 1, 7, 15, 1, 101), (1, 1, 7, 16, 2, 102), (1, 1, 8, 17, 3, 103)],
        "w int, d int, c int, order_id int, ts int, txn int",
    )
    done = spark.createDataFrame([(1, 1, 15, 6, 25)], "w int, d int, order_id int, carrier int, ts int")
    balance = spark.createDataFrame([(1, 1, 7, D("2.50"))], "w int, d int, c int, balance decimal(22,2)")
    state = views.customer_state(placed, done, balance)
    # the older order was delivered: money counts, the carrier does not show
    assert rows(state, "c", "order_id", "carrier", "balance") == [(7, 16, None, D("2.50")), (8, 17, None, D("-10.00"))]
    done = spark.createDataFrame([(1, 1, 16, 6, 25)], done.schema)
    state = views.customer_state(placed, done, balance)
    assert rows(state.where("c = 7"), "carrier", "delivered", "balance") == [(6, 25, D("2.50"))]
    lines = spark.createDataFrame([(102, 0, 5, 1, 2, D("1.00"))], "txn int, line int, item int, supply_w int, quantity int, amount decimal(22,2)")
    assert rows(views.order_status_lines(state, lines), "line", "delivered") == [(0, 25)]


def test_compaction_and_duplicates(spark):
    log = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("b", 2, None), ("c", 9, 1)], "k string, seq int, value int")
    assert rows(logs.latest_per_key(log, ["k"], ["seq"], "value"), "k", "value") == [("a", 6), ("c", 1)]
    assert rows(logs.first_per_key(log, ["k"], ["seq"]), "k", "seq", "value") == [("a", 1, 5), ("b", 1, 7), ("c", 9, 1)]
    assert logs.as_of(log, 1, "seq").count() == 2


def test_lookups(spark):
    table = spark.createDataFrame([(1, "one"), (2, "two")], "item int, name string")
    asked = spark.createDataFrame([(1,), (1,), (3,)], "item int")
    assert rows(logs.lookup(asked, table, ["item"]), "item", "name") == [(1, "one")]
    assert rows(logs.missing_keys(asked, table, ["item"]), "item") == [(3,)]
    with pytest.raises(Exception, match="no row for key 3"):
        logs.lookup_strict(asked, table, ["item"]).collect()


def test_partial_results(spark):
    parts = spark.createDataFrame(
        [(1, 0, 0, "x", None), (1, 0, 1, None, 5), (1, 1, 0, "y", None), (2, 0, 0, "old", 1), (2, 0, 1, "new", None)],
        "txn int, line int, seq int, name string, level int",
    )
    merged = results.merge_partials(parts, ["txn", "line"], ["name", "level"])
    assert rows(merged, "txn", "line", "name", "level", "complete") == [
        (1, 0, "x", 5, True), (1, 1, "y", None, False), (2, 0, "new", 1, True)
    ]


def test_status_and_timeouts(spark):
    sent = spark.createDataFrame([(i, 0) for i in range(1, 6)], "txn int, sent int")
    approvals = spark.createDataFrame([(1, True), (2, False), (3, True)], "txn int, approved boolean")
    done = spark.createDataFrame([(3, True), (4, True)], "txn int, done boolean")
    got = results.status(sent, approvals, done)
    assert rows(got, "txn", "status") == [(1, "accepted"), (2, "rejected"), (3, "complete"), (4, "complete"), (5, "written")]
    answers = spark.createDataFrame([(1, 90_000), (2, 90_001), (3, None)], "txn int, result int")
    assert [t for (t,) in rows(results.timeouts(sent, answers), "txn")] == [2, 3, 4, 5]


def test_updates_change_only_the_named_rows(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    updates = spark.createDataFrame([(2, None)], "k int, n int")
    assert rows(relational.apply_updates(table, updates, ["k"]), "k", "name", "n") == [(1, "a", 5), (2, "b", None)]


def test_checks_find_what_is_broken(spark):
    pending = spark.createDataFrame([(1, 1, 4), (1, 1, 6), (1, 2, 3)], "w int, d int, order_id int")
    assert rows(checks.violations(checks.contiguous(pending)), "w", "d") == [(1, 1)]
    ids = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], "w int, d int, next_id int")
    assert rows(checks.violations(checks.next_id(ids, pending)), "w", "d") == [(1, 2)]
    state = spark.createDataFrame([(1, 1, 4, None), (1, 1, 5, None), (1, 2, 3, 8)], "w int, d int, order_id int, carrier int")
    assert rows(checks.violations(checks.carrier(state, pending)), "order_id") == [(3,), (5,)]
    lines = spark.createDataFrame([(1, 5, 6), (2, None, 6), (3, None, None)], "line int, delivered int, carrier int")
    assert rows(checks.violations(checks.delivery_date(lines)), "line") == [(2,)]
    log = spark.createDataFrame(
        [(1, 1, 1, 1, 2, 1, D("-5.00"), D("-15.00")), (1, 1, 1, 2, 1, 2, D("4.00"), D("-11.00")), (1, 1, 1, 3, 2, 3, D("-1.00"), D("-13.00"))],
        "w int, d int, c int, ts int, kind int, txn int, change decimal(22,2), balance decimal(22,2)",
    )
    opening = F.lit("-10.00").cast("decimal(22,2)")
    assert rows(checks.violations(checks.payment_delta(log, 2, opening)), "txn") == [(3,)]


def test_line_without_stock_row_is_an_error(spark):
    lines = spark.createDataFrame([(1, 2, 7, 3), (2, 2, 8, 1)], "txn int, supply_w int, item int, d int")
    stock_rows = spark.createDataFrame([(2, 7)], "w int, item int")
    dist = F.array(*[F.concat(F.lit(f"{d}-"), F.col("item").cast("string")) for d in range(1, 11)])
    known = orders.with_dist_info(lines.where("item = 7"), stock_rows, dist)
    assert rows(known, "txn", "dist_info") == [(1, "3-7")]
    with pytest.raises(Exception, match="no stock row for 2 8"):
        orders.with_dist_info(lines, stock_rows, dist).collect()
    with pytest.raises(Exception, match="no row for key 2, 8"):
        logs.lookup_strict(lines.withColumnRenamed("supply_w", "w"), stock_rows, ["w", "item"]).collect()
