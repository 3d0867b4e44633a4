"""Every query by name, as a function of (session, folder). Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import keys as K
from tillroll.functions.draws import nurand
from tillroll.functions.text import last_name
from tillroll.operators import (
    accounts,
    asof,
    checks,
    customers,
    logs,
    metrics,
    modifications,
    orders,
    queue,
    relational,
    results,
    stock,
    verify,
    views,
)
from tillroll.plans.ledger import Ledger
from tillroll.session import settle
from tillroll.sources import generate, records
from tillroll.streaming import pipelines as P
from tillroll.streaming import workers
from tillroll.streaming.replay import Replay
from tillroll.sources.shop import MONEY, OPENING_BALANCE, PAYMENT, Shop, home, home_district, initial_stock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF_MS = 883612800000  # 1998-01-01
BALANCE_LOG = "w int, d int, c bigint, ts bigint, kind int, txn bigint, change_cents bigint, balance_cents bigint"


def tidy(df: DataFrame) -> DataFrame:
    """Money as double, whole numbers as bigint."""
    def plain(field):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(field.name).cast("long")
        return F.col(field.name)

    return df.select(*[plain(f).alias(f.name) for f in df.schema])


def query(fn: Callable[[Ledger], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(fn(Ledger(spark, folder)))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- logs and records -----------------------------------------------------------


def all_requests(x: Ledger) -> DataFrame:
    """The request log: every request with type, kind, id, time and the warehouse it goes to."""
    def part(df, kind, name, warehouse="w"):
        return df.select(
            F.lit(name).alias("type"), F.lit(kind).alias("kind"), "txn", "ts", F.col(warehouse).alias("w")
        )

    return (
        part(x.shop.orders, 0, "neworder")
        .unionByName(part(x.shop.deliveries, 1, "delivery"))
        .unionByName(part(x.shop.payments, 2, "payment", "c_w"))
    )


@query
def request_log(x):
    return all_requests(x)


@query
def route_counts(x):
    return verify.known_types(all_requests(x)).groupBy("type", "w").agg(F.count("*").alias("n"))


# clients that send requests in turn
CONNECTIONS = 8


def approval_log(x: Ledger) -> DataFrame:
    """One approval per new-order request, keyed by packed id: id, connection, txn, approved."""
    packed = K.pack_txn(*K.connection_of(F.col("txn"), CONNECTIONS))
    return x.approvals.select(
        packed.alias("id"), K.txn_connection(packed).alias("connection"), "txn", "approved"
    )


@query
def results_for_connection(x):
    """Each connection keeps its own results; every even connection is asked for."""
    results_in = approval_log(x)
    asked = x.shop.orders.select(K.connection_of(F.col("txn"), CONNECTIONS)[1].alias("connection")).where("connection % 2 = 0")
    return results.own_results(results_in, asked)


@query
def result_log(x):
    """What clients are sent: an approval or rejection per request, and a result from
    each warehouse that acted on it."""
    checked = x.approvals.select("txn", F.lit("neworder").alias("type"), "approved")
    sure = all_requests(x).where("type <> 'neworder'").select("txn", "type", F.lit(True).alias("approved"))
    approvals = checked.unionByName(sure).withColumn("is_approval", F.lit(True))
    worked = accepted_log(x).withColumn("is_approval", F.lit(False))
    return approvals.unionByName(worked, allowMissingColumns=True)


@query
def log_peek(x):
    """Approvals of the transactions that name an item nobody sells."""
    chosen = verify.unknown_items(x.shop.plain_lines, x.shop.items).select("txn")
    return logs.peek(approval_log(x).select("txn", "approved"), chosen)


def encoded_requests(x: Ledger) -> DataFrame:
    """The request log with JSON payloads. A new order is its header and a record for each line, whatever
    its size; ``part`` is the line's number."""
    new = x.shop.orders.select(
        F.lit("neworder").alias("type"), "txn", F.lit(0).alias("part"),
        records.encode(
            type=F.lit("neworder"), customerId=F.col("c"), districtId=F.col("d"), warehouseId=F.col("w"), date=F.col("ts")
        ).alias("value"),
    )
    lines = x.shop.lines.select(
        F.lit("neworder-line").alias("type"), "txn", F.col("line").alias("part"),
        records.encode(
            type=F.lit("neworder-line"), lineNumber=F.col("line"), itemId=F.col("item"),
            supplyingWarehouseId=F.col("supply_w"), quantity=F.col("quantity"),
        ).alias("value"),
    )
    paid = x.shop.payments.select(
        F.lit("payment").alias("type"), "txn", F.lit(0).alias("part"), encoded_payment().alias("value")
    )
    done = x.shop.deliveries.select(
        F.lit("delivery").alias("type"), "txn", F.lit(0).alias("part"),
        records.encode(
            type=F.lit("delivery"), warehouseId=F.col("w"), carrierId=F.col("carrier"), deliveryDate=F.col("ts")
        ).alias("value"),
    )
    return new.unionByName(lines).unionByName(paid).unionByName(done)


def encoded_payment():
    return records.encode(
        type=F.lit("payment"), customerId=F.col("c"), customerLastName=F.col("last"),
        districtId=F.col("d"), warehouseId=F.col("w"), customerDistrictId=F.col("c_d"),
        customerWarehouseId=F.col("c_w"), amount=F.col("amount"),
    )


@query
def json_decode(x):
    """Requests written as JSON and read back by type."""
    log = encoded_requests(x)
    new = records.decode(log, "neworder", records.REQUESTS).select(
        F.lit("neworder").alias("type"), "txn", F.col("r.warehouseId").alias("w"), F.col("r.districtId").alias("d"),
        F.col("r.customerId").alias("c"), F.col("r.date").alias("date"),
    )
    lines = records.decode(log, "neworder-line", records.REQUESTS).groupBy("txn").agg(
        F.count("*").alias("n_lines"), F.sum("r.quantity").alias("quantity")
    )
    new = new.join(lines, "txn", "left").fillna(0, ["n_lines", "quantity"])
    paid = records.decode(log, "payment", records.REQUESTS).select(
        F.lit("payment").alias("type"), "txn", F.col("r.warehouseId").alias("w"), F.col("r.districtId").alias("d"),
        F.col("r.customerId").alias("c"), F.col("r.customerLastName").alias("last"), F.col("r.amount").alias("amount"),
    )
    done = records.decode(log, "delivery", records.REQUESTS).select(
        F.lit("delivery").alias("type"), "txn", F.col("r.warehouseId").alias("w"),
        F.col("r.deliveryDate").alias("date"), F.col("r.carrierId").alias("carrier"),
    )
    return new.unionByName(paid, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)


# Fixed value: the most lines an order message holds; an order with more is sent as several.
LINES_PER_MESSAGE = 15


@query
def json_nested_orders(x):
    """Order messages with their lines nested, written as JSON, read back and unfolded. Every other order has its
    lines under the older name."""
    number = F.col("line") % LINES_PER_MESSAGE
    line = F.struct(number.alias("n"), F.col("item").alias("itemId"), F.col("supply_w").alias("supplyingWarehouseId"), "quantity")
    part = F.floor(F.col("line") / LINES_PER_MESSAGE).cast("int").alias("part")
    messages = x.shop.lines.groupBy("txn", part, "w", "d", "c", "ts").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    nested = F.transform("_lines", lambda v: v.dropFields("n"))
    older = F.col("txn") % 2 == 1
    log = messages.select("txn", "part", records.encode(
        type=F.lit("neworder"), customerId=F.col("c"), districtId=F.col("d"), warehouseId=F.col("w"), date=F.col("ts"),
        lines=F.when(~older, nested), items=F.when(older, nested),
    ).alias("value"))
    read = records.decode(log, "neworder", records.REQUESTS).select("txn", "part", "r", F.posexplode("r.lines").alias("n", "l"))
    return read.select(
        "txn", "part", F.col("r.warehouseId").alias("w"), F.col("r.districtId").alias("d"), F.col("r.customerId").alias("c"),
        F.col("r.date").alias("date"), (F.col("part") * LINES_PER_MESSAGE + F.col("n")).alias("line"),
        F.col("l.itemId").alias("item"), F.col("l.supplyingWarehouseId").alias("supply_w"), F.col("l.quantity").alias("quantity"),
    )


@query
def json_props(x):
    """The events' own JSON: fields of another shape."""
    parsed = F.from_json("props", "k int, missing string")
    return x.shop.table("events").select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query
def json_roundtrip(x):
    """Payments as JSON: absent fields are left out of the text, and come back as null."""
    log = x.shop.payments.select("txn", encoded_payment().alias("value"))
    return records.decode(log, "payment", records.REQUESTS).select(
        "txn",
        F.contains("value", F.lit("customerId")).alias("has_id"),
        F.contains("value", F.lit("customerLastName")).alias("has_name"),
        F.col("r.customerId").alias("c"), F.col("r.customerLastName").alias("last"), F.col("r.amount").alias("amount"),
    )


@query
def binary_keys(x):
    """Accepted-log keys as 12 big-endian bytes, and read back; ids with the high bit set, too."""
    key = K.encode_key("accepted", F.col("id"), F.col("w"))
    log = x.shop.orders.select("txn", F.col("w"), (-F.col("txn") - 1).alias("id")).withColumn("key", key)
    fields = K.decode_key("accepted", F.col("key"))
    return log.select(
        "txn", F.hex("key").alias("key"), fields[0].alias("id"), fields[1].alias("w"),
        F.hex(K.encode_key("modification", F.col("id"), F.col("w"))).alias("modification_key"),
    )


@query
def txn_id_codec(x):
    serial, connection = K.connection_of(F.col("txn"), CONNECTIONS)
    packed = x.shop.orders.select("txn", K.pack_txn(serial, connection - 4).alias("id"))
    return packed.select(
        "txn", "id", K.txn_serial(F.col("id")).alias("serial"), K.txn_connection(F.col("id")).alias("connection")
    )


def accepted_log(x: Ledger) -> DataFrame:
    new = verify.order_warehouses(x.accepted, x.shop.bare_lines).withColumn("type", F.lit("neworder"))
    paid = x.shop.payments.select("txn", F.col("c_w").alias("w"), F.lit("payment").alias("type"))
    done = x.shop.deliveries.select("txn", "w", F.lit("delivery").alias("type"))
    return new.unionByName(paid).unionByName(done)


@query
def accepted_fanout(x):
    return accepted_log(x)


@query
def partition_assign(x):
    log = verify.order_warehouses(x.accepted, x.shop.bare_lines)
    return log.select(
        "txn", "w",
        K.partition_of(F.col("w"), 4).alias("part"),
        K.partition_of(F.col("txn") % 8 - 4, 5).alias("result_part"),
    )


@query
def dedup_log(x):
    log = verify.order_warehouses(x.accepted, x.shop.bare_lines).withColumn("copy", F.lit(0))
    again = log.where("txn % 10 = 0").withColumn("copy", F.lit(1))
    return logs.first_per_key(log.unionByName(again), ["txn", "w"], ["copy"])


@query
def compact_log(x):
    log = x.shop.table("events").select(
        "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return logs.latest_per_key(log, ["user_id"], ["event_id"], "value")


@query
def modification_log(x):
    return x.modifications


# ---- verification and lookups -----------------------------------------------------


@query
def verify_orders(x):
    return x.approvals.select("txn", "approved")


@query
def verify_all(x):
    """Every request and, as requests of no known type, the page views."""
    strange = x.shop.table("events").where("event_type = 'view'").select(
        F.lit("view").alias("type"), F.col("event_id").alias("txn")
    )
    log = all_requests(x).select("type", "txn").unionByName(strange)
    checked = x.approvals.select(F.lit("neworder").alias("type"), "txn", "approved")
    return log.join(checked, ["type", "txn"], "left").select(
        "type", "txn", verify.approve_by_type(F.col("type"), F.col("approved")).alias("approved")
    )


@query
def unknown_items(x):
    return verify.unknown_items(x.shop.plain_lines, x.shop.items).groupBy("txn", "item").agg(F.count("*").alias("n"))


@query
def missing_keys(x):
    return logs.missing_keys(x.shop.plain_lines, x.shop.items, ["item"])


@query
def lookup_warehouse(x):
    return logs.lookup(x.shop.payments, x.shop.warehouses, ["w"])


@query
def lookup_district(x):
    return logs.lookup(x.shop.payments, x.shop.districts, ["w", "d"])


@query
def lookup_customer(x):
    asked = x.shop.payments.where("c is not null").select(F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c")
    return logs.lookup(asked, x.shop.customers, ["w", "d", "c"]).select(
        "w", "d", "c", "first", "last", "credit", "discount", "phone", "since"
    )


@query
def lookup_item(x):
    return logs.lookup(x.shop.plain_lines, x.shop.items, ["item"])


@query
def lookup_stock(x):
    asked = x.unnumbered_lines.select(F.col("supply_w").alias("w"), "item")
    return logs.lookup_strict(asked, x.opening_stock, ["w", "item"])


@query
def lookup_pending(x):
    return queue.oldest_pending(x.pending.select("w", "d", "order_id", "txn", "c", "total"))


# ---- orders and lines ---------------------------------------------------------------


@query
def order_ids(x):
    return x.numbered.select("txn", "w", "d", "c", "ts", "order_id")


@query
def order_lines(x):
    lines = x.shop.with_header(x.shop.request_lines, x.numbered.select("txn", "w", "d", "order_id"))
    priced = orders.priced_lines(lines, x.shop.items.select("item", "price")).drop("price")
    return x.with_dist_info(priced)


@query
def enrich_lines(x):
    return x.priced.select("txn", "line", "item", "item_name", "price", "quantity", "amount")


@query
def line_dist_info(x):
    texts = x.with_dist_info(x.unnumbered_lines)
    return texts.groupBy("supply_w", "item", "d", "dist_info").agg(F.count("*").alias("n"))


@query
def neworder_header(x):
    who = x.shop.customers.select("w", "d", "c", "last", "credit", "discount")
    return (
        x.numbered.select("txn", "w", "d", "c", "order_id", "ts")
        .join(x.shop.warehouses.select("w", "w_tax"), "w")
        .join(x.shop.districts.select("w", "d", "d_tax"), ["w", "d"])
        .join(who, ["w", "d", "c"])
    )


@query
def order_summary(x):
    priced = orders.priced_lines(x.unnumbered_lines, x.shop.items)
    return orders.summary(x.accepted.select("txn", "w", "d", "c"), priced)


@query
def order_amount_sql(x):
    """SUM over an order's lines, null for an order without lines."""
    return x.accepted_with_totals.select(
        "txn", F.when(F.col("n_lines") > 0, F.col("total")).alias("amount")
    )


@query
def new_orders(x):
    """Every new-order request with its outcome."""
    numbered = x.numbered.select("txn", "order_id")
    who = x.shop.customers.select("w", "d", "c", "last", "credit", "discount")
    return (
        x.approvals_with_totals.join(numbered, "txn", "left")
        .join(who, ["w", "d", "c"])
        .join(x.shop.warehouses.select("w", "w_tax"), "w")
        .join(x.shop.districts.select("w", "d", "d_tax"), ["w", "d"])
        .withColumn("total", F.when(F.col("approved"), F.col("total")))
    )


@query
def recent_orders(x):
    return x.recent.select("w", "d", "order_id", "txn", "c")


@query
def latest_orders(x):
    return orders.latest_per_customer(x.numbered.select("w", "d", "c", "order_id", "txn", "ts"))


@query
def latest_order_lines(x):
    latest = orders.latest_per_customer(x.numbered.select("w", "d", "c", "order_id", "txn"))
    return latest.join(x.priced.select("txn", "line", "item", "supply_w", "quantity", "amount"), "txn")


# ---- stock ------------------------------------------------------------------------


@query
def stock_levels(x):
    return x.moved.where("role <> 'look'").select("stock_w", "item", "ts", "txn", "line", "quantity", "level")


@query
def bulk_stock_levels(x):
    """Levels where lines take up to 250 at once, so that one restocking may not do."""
    moved = stock.movements(x.bulk_lines, any_quantity=True)
    levels = stock.with_levels(moved, any_quantity=True, **x.stock_bounds)
    return levels.where("role <> 'look'").select("stock_w", "item", "ts", "txn", "line", "quantity", "level")


@query
def bulk_stock(x):
    """The levels these lines end with."""
    moved = stock.movements(x.bulk_lines, any_quantity=True)
    return stock.current_levels(moved, any_quantity=True, **x.stock_bounds)


@query
def home_stock_asof(x):
    """For every line, the level of its item at home just then."""
    return x.moved.where("role <> 'supply'").select("txn", "line", "w", "item", "level")


@query
def home_stock_joined(x):
    """As ``home_stock_asof``, by joining every line as of its moment to the levels that its home warehouse's item
    had after each line served there (the opening level before the first)."""
    moved = settle(x.moved)
    lines = moved.where("role <> 'supply'").select("txn", "line", "w", "item", "ts")
    served = moved.where("role <> 'look'").select(
        F.col("stock_w").alias("w"), "item", F.struct("ts", "txn", "line").alias("at"), F.col("level").alias("served_level")
    )
    joined = asof.join_asof(
        lines.withColumn("at", F.struct("ts", "txn", "line")), served, ["w", "item"], "at", **x.stock_bounds
    )
    return joined.select("txn", "line", "w", "item", F.coalesce("served_level", initial_stock(F.col("item"))).alias("level"))


@query
def remote_stock(x):
    return x.moved.where("role = 'supply'").select("txn", "line", "stock_w", "item", "level")


@query
def view_stock(x):
    return modifications.view_stock(modifications.stock_writes(x.stock_modifications))


@query
def stock_level(x):
    lines = x.recent.select("txn").join(x.unnumbered_lines, "txn")
    return stock.low_stock(lines, x.levels, x.thresholds)


@query
def stock_level_sql(x):
    """Counts rows, not items, and reaches back 20 from the next order id."""
    newest = x.accepted.groupBy("w", "d").agg(F.count("*").alias("newest"))
    recent = orders.recent_orders(x.numbered, depth=20, newest=newest)
    lines = recent.select("txn").join(x.unnumbered_lines, "txn")
    return stock.low_stock(lines, x.levels, x.thresholds, distinct=False)


@query
def stock_counters(x):
    return stock.counters(x.unnumbered_lines)


# ---- deliveries ----------------------------------------------------------------------


@query
def fifo_deliveries(x):
    """Every poll and the order it popped, null from an empty queue."""
    return x.district_log.where("kind = 1").select("w", "d", "ts", "txn", "order_id")


@query
def deliveries(x):
    return x.delivered


@query
def deliveries_in_two_runs(x):
    """The log cut in two, the second run starting from the state of the first."""
    return x.delivered_in_two_runs


@query
def delivery_result(x):
    """The district -> order map of each delivery, as rows; a delivery of nothing has one empty row."""
    done = queue.delivery_results(x.shop.deliveries, x.delivered)
    return done.select("txn", "w", "carrier", F.explode_outer("orders").alias("d", "order_id"))


@query
def pending_orders(x):
    return x.pending.select("w", "d", "order_id", "txn", "c", "total")


@query
def oldest_pending(x):
    return queue.oldest_pending(x.pending.select("w", "d", "order_id", "txn", "c"))


# ---- customers and money ---------------------------------------------------------------


@query
def customers_by_name(x):
    return customers.by_first_name(x.shop.customers.select("w", "d", "last", "first", "c"), **x.name_bounds)


@query
def middle_customer(x):
    return customers.middle_customers(x.shop.customers, **x.name_bounds)


@query
def middle_customer_sql(x):
    return customers.middle_customers(x.shop.customers, "sql", **x.name_bounds)


@query
def balances(x):
    return x.balances


@query
def credit_data(x):
    return x.credit_data.select("txn", "c", "c_w", "c_d", "data")


@query
def payments(x):
    """Every payment: the customer it resolved to, how, and the balance after it."""
    after = x.balances.where(F.col("kind") == PAYMENT).select("txn", "balance")
    return x.payments.select("txn", "c", "c_w", "c_d", "amount", F.col("last").isNotNull().alias("by_name")).join(after, "txn")


@query
def payment_result(x):
    return accounts.payment_results(
        x.payments, x.balances, x.credit_data, x.shop.customers, x.shop.warehouses, x.shop.districts
    )


@query
def customer_ytd(x):
    return accounts.year_to_date(x.payments, x.delivered)


@query
def ytd_by_district(x):
    return accounts.district_takings(x.shop.payments)


@query
def history(x):
    return accounts.history(x.payments, x.shop.warehouses, x.shop.districts)


@query
def view_balance(x):
    return x.state.select("w", "d", "c", "balance")


@query
def view_balance_compat(x):
    """Payments applied under the paying district's key instead of the customer's."""
    changed = accounts.changes(views.payment_key(x.payments, compat=True), x.delivered)
    return views.customer_state(x.log_orders, x.delivered, accounts.current_balances(changed)).select(
        "w", "d", "c", "balance"
    )


@query
def order_status(x):
    return views.order_status(x.state, x.shop.customers)


@query
def order_status_by_name(x):
    """The same for the customer each last name stands for."""
    middle = customers.middle_customers(x.shop.customers, **x.name_bounds)
    return views.order_status(x.state, x.shop.customers).join(middle, ["w", "d", "last", "c"], "left_semi")


@query
def order_status_lines(x):
    return views.order_status_lines(x.state, x.priced)


# ---- results and timing -----------------------------------------------------------------


@query
def merge_results(x):
    parts = results.line_partials(x.moved, x.priced)
    return results.merge_partials(parts, ["txn", "line"], ["item_name", "price", "amount", "stock_quantity"])


@query
def txn_status(x):
    """Each order request as seen at the start of 1998: approvals and deliveries up to then are known."""
    seen = x.approvals.where(F.col("ts") <= AS_OF_MS).select("txn", "approved")
    done = x.delivery_times.where(F.col("result") <= AS_OF_MS).select("txn", F.lit(True).alias("done"))
    return results.status(x.shop.orders.select("txn", "w", "d"), seen, done)


@query
def stage_latency(x):
    """From the request's entry in the log to the shipping of its first line, of its last line, and to its
    delivery: times from the request log, the lines and the delivery log."""
    sent = x.accepted.select("txn", F.col("ts").alias("sent"), F.col("ts").alias("written"))
    return results.stage_latency(
        sent,
        x.shipping_times.select("txn", F.col("first").alias("accepted")),
        x.shipping_times.select("txn", F.col("last").alias("routed")),
        x.delivery_times,
    )


@query
def timeouts(x):
    """Accepted orders not delivered within thirty days."""
    sent = x.accepted.select("txn", F.col("ts").alias("sent"))
    return results.timeouts(sent, x.delivery_times, 30 * 86_400_000)


@query
def duration_stats(x):
    durations = x.shop.table("events").select(
        F.col("ts").cast("timestamp").alias("t"),
        F.col("event_type").alias("event"),
        F.col("value").cast(MONEY).alias("duration"),
    )
    return metrics.duration_stats(durations, "1 day", limit=90, **x.payment_bounds)


# ---- the log as of a point, and rebuilt -------------------------------------------------


@query
def state_as_of(x):
    """Next order id and queue length of each district at the start of 1998."""
    log = logs.as_of(x.district_log, AS_OF_MS)
    return log.groupBy("w", "d").agg(
        (F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("order_id"))), F.lit(0)) + 1).alias("next_id"),
        (F.count_if(F.col("kind") == 0) - F.count_if((F.col("kind") == 1) & F.col("order_id").isNotNull())).alias("pending"),
    )


@query
def rebuild_equals_live(x):
    """Stock as replayed from the modification log next to stock as kept by the workers."""
    rebuilt = modifications.view_stock(modifications.stock_writes(x.modifications)).withColumnRenamed("level", "rebuilt")
    live = x.levels.withColumnRenamed("level", "live")
    return rebuilt.join(live, ["stock_w", "item"], "full")


# ---- kept up to date by streams ----------------------------------------------------------------


def district_streams(r: Replay) -> None:
    r.log(P.district_stream(r.accepted()), "district")


@query
def stream_deliveries(x):
    """The queues as a stream: every order delivered."""
    log = Replay(x).run(district_streams).read("district", P.DISTRICT_LOG)
    total = (F.col("total_cents") / 100).alias("total")
    return log.where("kind = 1").select("w", "d", "order_id", "txn", "ts", "carrier", "c", total)


@query
def stream_order_status(x):
    """The view of customers as a stream: newest order, its delivery, balance."""
    opening = round(float(OPENING_BALANCE) * 100)

    def streams(r: Replay) -> None:
        district_streams(r)
        r.view(P.view_customers(r.accepted(), r.district(), r.middle, opening), "customers")

    state = Replay(x).run(streams).latest("customers", ["w", "d", "c"]).where("order_id is not null")
    balance = (F.col("balance_cents") / 100).alias("balance")
    return state.select("w", "d", "c", "order_id", "ts", "txn", "carrier", "delivered", balance)


@query
def stream_recent_orders(x):
    """The view of each district's newest orders as a stream."""

    def streams(r: Replay) -> None:
        district_streams(r)
        r.log(P.recent_stream(r.district()), "recent")

    log = Replay(x).run(streams).read("recent", P.RECENT_LOG)
    newest = log.groupBy("w", "d").agg(F.max("newest").alias("newest"))
    return log.join(newest, ["w", "d", "newest"]).select("w", "d", "order_id", "txn", "c")


@query
def stream_credit_data(x):
    """The bad-credit texts as a stream."""
    replay = Replay(x).run(lambda r: r.log(P.credit_stream(r.accepted(), r.middle, x.shop.customers), "credit"))
    return replay.read("credit", P.CREDIT_LOG).select("txn", "c", "c_w", "c_d", "data")


@query
def stream_balances(x):
    """Every balance the workers keep as a stream, payments and deliveries of a slice together."""
    opening = round(float(OPENING_BALANCE) * 100)

    def streams(r: Replay) -> None:
        district_streams(r)
        changes = P.balance_changes(r.accepted(), r.district(), r.middle)
        r.log(P.balance_stream(changes, opening), "balances")

    log = Replay(x).run(streams).read("balances", BALANCE_LOG)
    return log.select("w", "d", "c", "ts", "kind", "txn", (F.col("change_cents") / 100).alias("change"), (F.col("balance_cents") / 100).alias("balance"))


def worked(r: Replay) -> None:
    r.work()
    r.account()


@query
def stream_modification_log(x):
    """The modification log as the workers' streams write it."""
    return Replay(x).run(worked, lines=True).read("modifications", workers.MODIFICATION)


@query
def stream_result_log(x):
    """The parts of results as the workers' streams write them, each from the warehouse that has it."""
    return Replay(x).run(worked, lines=True).read("results", workers.RESULT)


@query
def stream_results(x):
    """Each transaction's result, put together from its parts as they come."""

    def streams(r: Replay) -> None:
        worked(r)
        r.log(workers.merged_stream(r.results()), "merged")

    return Replay(x).run(streams, lines=True).read("merged", workers.MERGED)


@query
def stream_stock_level(x):
    """Items of each district's newest orders that are low, kept up to date from the modification log."""
    threshold = ((F.col("w") * 10 + F.col("d")) % 11 + 10).alias("threshold")

    def streams(r: Replay) -> None:
        r.work()
        r.log(workers.stock_level_stream(r.modifications(), r.modifications(), threshold), "low")

    low = Replay(x).run(streams, lines=True).read("low", workers.LOW).groupBy("w", "d").agg(F.sum("change").alias("low"))
    return x.thresholds.join(low, ["w", "d"], "left").withColumn("low", F.coalesce("low", F.lit(0)))


@query
def stream_views(x):
    """The view of customers from the modification log alone, repeats left out."""
    opening = round(float(OPENING_BALANCE) * 100)

    def streams(r: Replay) -> None:
        worked(r)
        with workers.once(r.spark):
            r.log(workers.first_copies(r.modifications(), workers.MODIFICATION_KEY), "told")
        r.view(P.customer_view(workers.customer_events(r._stream("told", workers.MODIFICATION)), opening), "customers")

    state = Replay(x).run(streams, lines=True).latest("customers", ["w", "d", "c"]).where("order_id is not null")
    balance = (F.col("balance_cents") / 100).alias("balance")
    return state.select("w", "d", "c", "order_id", "ts", "txn", "carrier", "delivered", balance)


# ---- relational form -------------------------------------------------------------------------


def summaries(x: Ledger) -> DataFrame:
    lines = x.unnumbered_lines.groupBy("txn").agg(F.bool_and(F.col("supply_w") == F.col("w")).alias("all_local"))
    return x.log_orders.join(x.accepted_with_totals.select("txn", "n_lines"), "txn").join(lines, "txn", "left").select(
        "w", "d", "order_id", "c", "ts", "n_lines", F.coalesce("all_local", F.lit(True)).alias("all_local")
    )


@query
def updated_orders(x):
    return relational.order_table(summaries(x), x.delivered)


@query
def sql_order_lines(x):
    lines = x.priced.select("txn", "line", "item", "supply_w", "quantity", "amount").join(
        x.log_orders.select("txn", "w", "d", "order_id"), "txn"
    )
    return relational.order_line_table(lines, x.delivered)


@query
def sql_stock(x):
    return relational.stock_table(x.opening_stock, x.levels, stock.counters(x.unnumbered_lines))


@query
def updated_customers(x):
    resolved = customers.resolve(x.shop.payments, x.shop.customers, "sql", **x.name_bounds)
    texts = accounts.current_credit_data(resolved, x.shop.customers, **x.payment_bounds)
    changed = accounts.changes(resolved, x.delivered)
    return relational.customer_table(
        x.shop.customers, accounts.current_balances(changed), accounts.year_to_date(resolved, x.delivered), texts
    )


@query
def sql_districts(x):
    newest = x.accepted.groupBy("w", "d").agg(F.count("*").alias("newest"))
    return relational.district_table(x.shop.districts, newest, accounts.ytd_by_district(x.shop.payments))


@query
def sql_warehouses(x):
    return relational.warehouse_table(x.shop.warehouses, accounts.ytd_by_warehouse(x.shop.payments))


# ---- checks -----------------------------------------------------------------------------------


@query
def check_next_id(x):
    next_ids = x.accepted.groupBy("w", "d").agg((F.count("*") + 1).alias("next_id"))
    return checks.next_id(next_ids, x.pending)


@query
def check_contiguous(x):
    return checks.contiguous(x.pending)


@query
def check_carrier(x):
    return checks.carrier(x.state, x.pending).select("w", "d", "c", "order_id", "waiting", "carrier", "ok")


@query
def check_delivery_date(x):
    lines = views.order_status_lines(x.state, x.priced).select("w", "d", "c", "txn", "line", "delivered")
    return checks.delivery_date(lines.join(x.state.select("w", "d", "c", "carrier"), ["w", "d", "c"]))


@query
def check_payment_delta(x):
    opening = F.lit(OPENING_BALANCE).cast("decimal(22,2)")
    return checks.payment_delta(x.balances, PAYMENT, opening, **x.balance_bounds).select("w", "d", "c", "txn", "before", "balance", "ok")


# ---- expressions and generators ------------------------------------------------------------------


@query
def last_names(x):
    return x.shop.table("customer").select(F.col("c_custkey").alias("c"), last_name(F.col("c_custkey") % 1000).alias("last"))


@query
def nurand_expr(x):
    first, second = F.col("l_partkey") % 256, F.col("l_orderkey") % 1000
    drawn = x.shop.table("lineitem").select(nurand(first, second, 0, 999).alias("drawn"))
    return drawn.groupBy("drawn").agg(F.count("*").alias("n"))


@query
def padded_fields(x):
    return x.shop.customers.select("c", "phone", F.col("opening_data").alias("data"))


def customer_keys(shop: Shop) -> DataFrame:
    return shop.table("customer").select(
        home("c_nationkey").alias("w"), home_district("c_custkey").alias("d"), F.col("c_custkey").alias("c")
    )


@query
def gen_item(x):
    return generate.items(x.shop.table("part").select(F.col("p_partkey").alias("item")))


@query
def gen_warehouse(x):
    return generate.warehouses(x.shop.table("nation").select(home("n_nationkey").alias("w")))


@query
def gen_district(x):
    return generate.districts(x.shop.table("nation").select(home("n_nationkey").alias("w")))


@query
def gen_customer(x):
    return generate.customers(customer_keys(x.shop), names=20)


@query
def gen_stock(x):
    return generate.stock(x.shop.table("part").select(F.col("p_partkey").alias("item")), x.shop.rows("nation"))


@query
def gen_orders(x):
    n_items = x.shop.rows("part")
    headers = generate.orders(customer_keys(x.shop), **x.name_bounds)
    lines = generate.order_lines(headers, n_items)
    return lines.join(headers.select("w", "d", "order_id", "c", "entered", "carrier"), ["w", "d", "order_id"])


# Seeds of the drawn tables; one table takes at most 30 in a row.
SEEDS = {"requests": 100, "new_orders": 200, "lines": 300, "payments": 400, "items": 500, "orders": 600, "others": 700}
DRAWN_CUSTOMERS, DRAWN_NAMES = 3000, 1000


def drawn(x) -> DataFrame:
    """A request of a drawn type for every order of the table."""
    ids = x.shop.table("orders").select(F.col("o_orderkey").alias("txn"))
    return generate.requests_for(ids, x.shop.rows("nation"), SEEDS["requests"])


@query
def drawn_requests(x):
    return drawn(x)


@query
def drawn_new_orders(x):
    asked = drawn(x).where("type = 'neworder'").drop("type")
    orders_ = generate.new_order_requests(asked, DRAWN_CUSTOMERS, 10, SEEDS["new_orders"])
    lines = generate.new_order_request_lines(orders_.drop("d", "c"), x.shop.rows("part"), x.shop.rows("nation"), SEEDS["lines"])
    return lines.join(orders_.select("txn", "d", "c", "n_lines"), "txn")


@query
def drawn_payments(x):
    asked = drawn(x).where("type = 'payment'").drop("type")
    return generate.payment_requests(asked, x.shop.rows("nation"), 10, DRAWN_CUSTOMERS, DRAWN_NAMES, SEEDS["payments"])


@query
def drawn_other_requests(x):
    """Deliveries, stock levels and order statuses, each with its own fields."""
    asked, seed = drawn(x), SEEDS["others"]

    def of(kind):
        return asked.where(F.col("type") == kind)

    parts = [
        generate.delivery_requests(of("delivery"), seed),
        generate.stock_level_requests(of("stocklevel"), 10, seed + 10),
        generate.order_status_requests(of("orderstatus"), DRAWN_CUSTOMERS, 10, DRAWN_NAMES, seed + 20).withColumn("type", F.lit("orderstatus")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query
def drawn_items(x):
    return generate.items(x.shop.table("part").select(F.col("p_partkey").alias("item")), SEEDS["items"])


@query
def drawn_orders(x):
    headers = generate.orders(customer_keys(x.shop), seed=SEEDS["orders"], **x.name_bounds)
    return headers.select("w", "d", "c", "order_id", "n_lines", "entered", "delivered", "carrier")
