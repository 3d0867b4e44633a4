"""The same processing as the logs grow.

Verifier, workers and views are separate streaming queries with durable logs
between them. State lives in RocksDB next to each query's checkpoint, keyed as
finely as the rules allow (item in a warehouse, district, customer), not by
warehouse, so a busy warehouse spreads out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tillroll.functions.keys import txn_connection
from tillroll.functions.text import bad_credit_prefix
from tillroll.operators import stock, verify
from tillroll.operators.accounts import DATA_LIMIT, PAYER
from tillroll.sources import records
from tillroll.sources.shop import DISTRICTS, PAYMENT, initial_stock
from tillroll.streaming.packs import Packed, keyed, packed
from tillroll.streaming.state import Balances, CreditText, DistrictQueue, RecentOrders, StockLevels

#: Customer numbers of a slot; a balance takes 16 bytes before it is packed.
SLOT = 524_288

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REQUEST = (
    "type string, txn bigint, ts bigint, w int, d int, c bigint, "
    "lines array<struct<line: int, item: bigint, supply_w: int, quantity: int>>, "
    "carrier int, last string, c_w int, c_d int, amount decimal(12,2)"
)
REQUEST_KEY = ["type", "txn"]
ACCEPTED = REQUEST + ", total decimal(22,2), worker_w int, part int"


def configure_state(spark: SparkSession) -> SparkSession:
    """State in RocksDB, backed up by change logs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


# ---- verifier -----------------------------------------------------------------


def decide(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requests with ``approved`` and, for new orders, ``total``. A request sent twice counts once."""
    requests = requests.dropDuplicates(REQUEST_KEY)
    orders = requests.where("type = 'neworder'").select("txn")
    lines = requests.where("type = 'neworder'").select("txn", F.explode("lines").alias("l")).select("txn", "l.*")
    checked = verify.approve_with_totals(orders, lines, items).select(
        F.lit("neworder").alias("type"), "txn", F.col("approved").alias("_ok"), "total"
    )
    return requests.join(checked, ["type", "txn"], "left").withColumn(
        "approved", verify.approve_by_type(F.col("type"), F.col("_ok"))
    ).drop("_ok")


def worker_warehouses() -> Column:
    """The warehouses that must act on a request."""
    suppliers = F.transform("lines", lambda line: line["supply_w"])
    return (
        F.when(F.col("type") == "neworder", F.array_distinct(F.array_append(suppliers, F.col("w"))))
        .when(F.col("type") == "payment", F.array("c_w"))
        .otherwise(F.array("w"))
    )


def fan_out(approved: DataFrame, partitions: int) -> DataFrame:
    """One record per (txn, warehouse), with its log partition."""
    return (
        approved.where("approved").drop("approved")
        .withColumn("worker_w", F.explode(worker_warehouses()))
        .withColumn("part", F.pmod("worker_w", F.lit(partitions)))
    )


def start_verifier(
    requests: DataFrame, items: DataFrame, accepted_path: str, approvals_path: str, checkpoint: str, partitions: int = 4
) -> StreamingQuery:
    """Write the accepted log (one folder per batch and partition) and the approvals (one per batch).

    A request sent again, in whichever batch, is decided once. A batch that is run again after a
    failure replaces what it wrote before; readers that have seen the earlier files drop
    duplicates by key.
    """

    def replace(df: DataFrame, batch_id: int, path: str, *parts: str) -> None:
        writer = df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch", *parts).parquet(path)

    def each(batch: DataFrame, batch_id: int) -> None:
        decided = decide(batch, items).persist()
        replace(fan_out(decided, partitions), batch_id, accepted_path, "part")
        replace(decided.select("type", "txn", "ts", "approved"), batch_id, approvals_path)
        decided.unpersist()

    return _start(without_duplicates(requests, REQUEST_KEY).writeStream.foreachBatch(each), checkpoint)


def _start(writer, checkpoint: str) -> StreamingQuery:
    """Run up to the end of the log as it is now: ready when the query stops."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a log folder, each record once."""
    return _start(stream.writeStream.format("parquet").option("path", path).option("compression", records.CODEC).outputMode("append"), checkpoint)


def without_duplicates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drop records whose key came before, however long ago. No watermark: a first copy passes however
    late it is. The state is one entry per key in RocksDB, for as long as the log is kept."""
    return stream.dropDuplicates(keys)


# ---- workers --------------------------------------------------------------------


def stock_movements(accepted: DataFrame) -> DataFrame:
    """What each accepted record makes its own warehouse take or look at."""
    lines = accepted.where("type = 'neworder'").withColumn("l", F.explode("lines"))
    supplies = F.col("l.supply_w") == F.col("worker_w")
    at_home = F.col("w") == F.col("worker_w")
    return lines.where(supplies | at_home).select(
        F.col("worker_w").alias("stock_w"),
        F.col("l.item").alias("item"),
        "ts", "txn",
        F.col("l.line").alias("line"),
        F.when(supplies & at_home, "home").when(supplies, "supply").otherwise("look").alias("role"),
        F.when(supplies, stock.checked(F.col("l.quantity"), any_quantity=True)).otherwise(0).alias("taken"),
        initial_stock(F.col("l.item")).alias("opening"),
    )


def stock_stream(accepted: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Levels after each movement; ``start`` (stock_w, item, level) is loaded first."""
    return stock_movements(accepted).groupBy("stock_w", "item").transformWithStateInPandas(
        StockLevels(),
        "stock_w int, item bigint, ts bigint, txn bigint, line int, role string, level int",
        outputMode="Append",
        timeMode="None",
        initialState=start.groupBy("stock_w", "item") if start is not None else None,
    )


def cents(money: Column) -> Column:
    return (money * 100).cast("long")


def district_events(accepted: DataFrame, *more: str) -> DataFrame:
    """Orders (kind 0, at their home warehouse) and polls (kind 1, ten per delivery), with ``more`` of their columns."""
    is_order = F.col("type") == "neworder"
    districts = F.when(is_order, F.array("d")).otherwise(F.sequence(F.lit(1), F.lit(DISTRICTS)))
    return (
        accepted.where((is_order & (F.col("worker_w") == F.col("w"))) | (F.col("type") == "delivery"))
        .withColumn("d", F.explode(districts))
        .select(
            "w", "d", "ts", F.when(is_order, 0).otherwise(1).alias("kind"), "txn", "c",
            cents(F.col("total")).alias("total_cents"), "carrier", *more,
        )
    )


def district_stream(accepted: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Numbered orders and deliveries. ``start`` holds the queues an earlier run left: w, d, next_id, and
    order_id, c, total_cents of one pending order in each row (null in a district's only row: none)."""
    keys = [F.col("w"), F.col("d")]
    return packed(district_events(accepted), *keys).groupBy("key").transformWithStateInPandas(
        Packed(DistrictQueue(), ["w", "d"]),
        "w int, d int, ts bigint, kind int, txn bigint, order_id bigint, c bigint, total_cents bigint, carrier int",
        outputMode="Append",
        timeMode="None",
        initialState=keyed(start, *keys) if start is not None else None,
    )


DISTRICT_LOG = (
    "w int, d int, ts bigint, kind int, txn bigint, order_id bigint, c bigint, total_cents bigint, carrier int"
)


def resolved_payments(accepted: DataFrame, middle: DataFrame) -> DataFrame:
    """Payments, their customer found by name where needed."""
    named = middle.select(
        F.col("w").alias("c_w"), F.col("d").alias("c_d"), "last", F.col("c").alias("_named")
    )
    paid = accepted.where("type = 'payment'").join(named, ["c_w", "c_d", "last"], "left")
    return paid.withColumn("c", F.coalesce("c", "_named")).drop("_named")


def balance_changes(accepted: DataFrame, district_log: DataFrame, middle: DataFrame) -> DataFrame:
    """Payments and deliveries."""
    paid = resolved_payments(accepted, middle).select(
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c", "ts",
        F.lit(PAYMENT).alias("kind"), "txn", (-cents(F.col("amount"))).alias("change_cents"),
    )
    owed = district_log.where("kind = 1").select(
        "w", "d", "c", "ts", "kind", "txn", F.col("total_cents").alias("change_cents")
    )
    return paid.unionByName(owed)


def slot() -> list[Column]:
    """The key of rows with w, d and c: a slot of a district's customers, whose state is kept together, so that a batch costs a few
    state calls a slot."""
    return [F.col("w"), F.col("d"), F.floor(F.col("c") / SLOT)]


def balance_stream(changes: DataFrame, opening_cents: int, start: DataFrame | None = None) -> DataFrame:
    """Balances after each change; ``start`` (w, d, c, cents) is loaded first."""
    return packed(changes, *slot()).groupBy("key").transformWithStateInPandas(
        Packed(Balances(opening_cents), []),
        "w int, d int, c bigint, ts bigint, kind int, txn bigint, change_cents bigint, balance_cents bigint",
        outputMode="Append",
        timeMode="None",
        initialState=keyed(start, *slot()) if start is not None else None,
    )


def credit_stream(accepted: DataFrame, middle: DataFrame, customers: DataFrame) -> DataFrame:
    """The text of each bad-credit customer after each payment; ``customers`` as the shop has them."""
    bad = customers.where("credit = 'BC'").select(F.col("w").alias("c_w"), F.col("d").alias("c_d"), "c", "opening_data").hint("merge")
    prefix = bad_credit_prefix(*[F.col(x) for x in ("c", "c_d", "c_w", "d", "w", "amount")])
    theirs = resolved_payments(accepted, middle).join(bad, PAYER).withColumn("prefix", prefix)
    return theirs.select(*PAYER, "ts", "txn", "prefix", "opening_data").groupBy(*PAYER).transformWithStateInPandas(
        CreditText(DATA_LIMIT), CREDIT_LOG, outputMode="Append", timeMode="None"
    )


CREDIT_LOG = "c_w int, c_d int, c bigint, ts bigint, txn bigint, data string"


# ---- views: plain streaming aggregates, but for the list of recent orders ---------------------------------------------


def view_stock(levels: DataFrame) -> DataFrame:
    """The last level written per (warehouse, item)."""
    return levels.groupBy("stock_w", "item").agg(F.max_by("level", F.struct("ts", "txn", "line")).alias("level"))


def view_latest_orders(district_log: DataFrame) -> DataFrame:
    return district_log.where("kind = 0").groupBy("w", "d", "c").agg(
        F.max("order_id").alias("order_id"), F.max_by("txn", "order_id").alias("txn")
    )


def view_customers(accepted: DataFrame, district_log: DataFrame, middle: DataFrame, opening_cents: int) -> DataFrame:
    """``customer_view`` of the accepted and district logs."""
    paid = resolved_payments(accepted, middle).select(
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c", F.lit(PAYMENT).alias("kind"), (-cents(F.col("amount"))).alias("change"),
    )
    ordered = district_log.select(
        "w", "d", "c", "kind", "ts", "txn", "order_id", "carrier", F.when(F.col("kind") == 1, F.col("total_cents")).alias("change")
    )
    return customer_view(ordered.unionByName(paid, allowMissingColumns=True), opening_cents)


def customer_view(events: DataFrame, opening_cents: int) -> DataFrame:
    """Per customer with orders or payments: balance, newest order, and its carrier and delivery time once it is
    delivered. A district delivers in order, so that is when the newest order delivered is the newest.

    ``events``: w, d, c, kind (0 order, 1 delivery), ts, txn, order_id, carrier, change (of the balance, in cents).
    """
    placed = F.when(F.col("kind") == 0, F.col("order_id"))
    done = F.when(F.col("kind") == 1, F.col("order_id"))
    state = events.groupBy("w", "d", "c").agg(
        F.max(placed).alias("order_id"), F.max_by(F.struct("ts", "txn"), placed).alias("placed"),
        F.max(done).alias("done_id"), F.max_by(F.struct("ts", "carrier"), done).alias("done"),
        F.coalesce(F.sum("change"), F.lit(0)).alias("change"),
    )
    is_done = F.col("order_id") == F.col("done_id")
    return state.select(
        "w", "d", "c", "order_id", F.col("placed.ts").alias("ts"), F.col("placed.txn").alias("txn"),
        F.when(is_done, F.col("done.carrier")).alias("carrier"), F.when(is_done, F.col("done.ts")).alias("delivered"),
        (F.col("change") + opening_cents).alias("balance_cents"),
    )


def recent_stream(district_log: DataFrame, depth: int = 20) -> DataFrame:
    """The newest orders of each district whenever it gets one; a reader keeps those with the largest ``newest``."""
    placed = district_log.where("kind = 0").select("w", "d", "order_id", "txn", "c")
    return packed(placed, F.col("w"), F.col("d")).groupBy("key").transformWithStateInPandas(
        Packed(RecentOrders(depth), ["w", "d"]), RECENT_LOG, outputMode="Append", timeMode="None"
    )


RECENT_LOG = "w int, d int, order_id bigint, txn bigint, c bigint, newest bigint"


def start_view(view: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch's changed rows to ``upsert``."""
    return _start(view.writeStream.outputMode("update").foreachBatch(upsert), checkpoint)


def result_tail(results: DataFrame, connection: int, since_ms: int) -> DataFrame:
    """Results sent to one connection from now on (``results``: id, ts, ...)."""
    return results.where((txn_connection(F.col("id")) == connection) & (F.col("ts") >= since_ms))


# ---- clients --------------------------------------------------------------------------


def status_stream(requests: DataFrame, approvals: DataFrame, results: DataFrame) -> DataFrame:
    """The status of each transaction as the logs tell it: written, accepted, rejected or complete.

    ``requests``: type, txn; ``approvals``: type, txn, approved; ``results``: type, txn, one row when the result is
    complete. Repeated records change nothing. A plain streaming aggregate, for update mode.
    """
    seen = requests.select("type", "txn").unionByName(approvals.select("type", "txn", "approved"), True).unionByName(
        results.select("type", "txn", F.lit(True).alias("done")), True
    )
    flags = seen.groupBy(*REQUEST_KEY).agg(F.bool_and("approved").alias("approved"), F.bool_or("done").alias("done"))
    return flags.select(
        *REQUEST_KEY,
        F.when(F.col("approved") == F.lit(False), "rejected").when(F.col("done"), "complete")
        .when(F.col("approved"), "accepted").otherwise("written").alias("status"),
    )


def start_callbacks(statuses: DataFrame, callbacks: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Call ``callbacks[status]`` with each batch's transactions of that status
    (written, accepted, rejected, complete); a transaction reaches a status once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for name, callback in callbacks.items():
            callback(batch.where(F.col("status") == name))

    once = without_duplicates(statuses, [*REQUEST_KEY, "status"])
    return _start(once.writeStream.foreachBatch(each), checkpoint)


def timeout_stream(sent: DataFrame, results: DataFrame, limit_ms: int, delay: str = "1 minute") -> DataFrame:
    """Transactions with no result in time, once the log has moved on far enough to know.

    ``sent``: txn, sent (ms); ``results``: txn, result (ms).
    """
    left = sent.withColumn("sent_at", F.timestamp_millis("sent")).withWatermark("sent_at", delay)
    right = results.select(F.col("txn").alias("r_txn"), "result").withColumn(
        "result_at", F.timestamp_millis("result")
    ).withWatermark("result_at", delay)
    limit = F.expr(f"INTERVAL {limit_ms / 1000} SECONDS")
    in_time = (
        (F.col("txn") == F.col("r_txn"))
        & (F.col("result_at") >= F.col("sent_at"))
        & (F.col("result_at") <= F.col("sent_at") + limit)
    )
    return left.join(right, in_time, "left_outer").where("r_txn is null").select("txn", "sent")


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A query's state as a table, read from its checkpoint."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


class ProgressMetrics(StreamingQueryListener):
    """Collects ``t, event, duration`` (ns) from each batch's progress.

    Records are handed to ``write`` whenever there are ``limit`` of them, and by ``drain`` at the end. Without a
    ``write`` they wait for ``drain``. None is dropped.
    """

    def __init__(self, limit: int = 10_000, write: Callable[[list[tuple[str, str, int]]], None] | None = None):
        self.limit = limit
        self.write = write
        self._records: list[tuple[str, str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, ms in p.durationMs.items():
            self._records.append((p.timestamp, name, int(ms) * 1_000_000))
        if self.write and len(self._records) >= self.limit:
            full, self._records = self._records, []
            self.write(full)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def drain(self, spark: SparkSession) -> DataFrame:
        records, self._records = self._records, []
        return spark.createDataFrame(records, "t string, event string, duration bigint")
