"""The streams end with what the batch jobs compute, also when stopped and started again."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY, rows
from tillroll.operators import customers
from tillroll.plans.ledger import Ledger
from tillroll.sources import records
from tillroll.streaming import pipelines as P

SLICES = 3


def write_requests(ledger, folder):
    """The request log, in log order: one file per slice of time, oldest first."""
    lines = ledger.shop.lines.groupBy("txn").agg(
        F.array_sort(F.collect_list(F.struct("line", "item", "supply_w", "quantity"))).alias("lines")
    )
    empty = F.array().cast("array<struct<line:int,item:bigint,supply_w:int,quantity:int>>")
    new = ledger.shop.orders.join(lines, "txn", "left").select(
        F.lit("neworder").alias("type"), "txn", "ts", "w", "d", "c", F.coalesce("lines", empty).alias("lines")
    )
    done = ledger.shop.deliveries.select(F.lit("delivery").alias("type"), "txn", "ts", "w", "carrier")
    paid = ledger.shop.payments.select(
        F.lit("payment").alias("type"), "txn", "ts", "w", "d", "c", "last", "c_w", "c_d", "amount"
    )
    log = new.unionByName(done, True).unionByName(paid, True)
    log = log.select(*[c.strip().split(" ")[0] for c in
                       "type,txn,ts,w,d,c,lines,carrier,last,c_w,c_d,amount".split(",")]).cache()
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) // SLICES + 1
    for i in range(SLICES):
        part = log.where((F.col("ts") >= low + i * step) & (F.col("ts") < low + (i + 1) * step))
        records.write_log(part.coalesce(1), folder)
        yield
    log.unpersist()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """All queries over the log, restarted after each slice of it has been written."""
    at = tmp_path_factory.mktemp("stream")
    path = lambda name: str(at / name)
    ledger = Ledger(spark, TINY)
    middle = customers.middle_customers(ledger.shop.customers)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def accepted():
        log = P_stream(spark, path("accepted"), P.ACCEPTED)
        return P.without_duplicates(log, ["type", "txn", "worker_w"])

    seen = {"accepted": 0, "rejected": 0, "written": 0}
    for i, _ in enumerate(write_requests(ledger, path("requests"))):
        requests = P_stream(spark, path("requests"), P.REQUEST)
        P.start_verifier(requests, ledger.shop.items, path("accepted"), path("approvals"), path("cp/verify")).awaitTermination()
        if i == 1:
            # the whole accepted log of one partition arrives again
            again = spark.read.schema(P.ACCEPTED).parquet(path("accepted")).where("part = 1")
            again.withColumn("batch", F.col("batch") + 1000).write.mode("append").partitionBy("batch", "part").parquet(path("accepted"))
        P.start_log(P.stock_stream(accepted()), path("stock"), path("cp/stock")).awaitTermination()
        P.start_log(P.district_stream(accepted()), path("district"), path("cp/district")).awaitTermination()
        district = P_stream(spark, path("district"), P.DISTRICT_LOG)
        changes = P.balance_changes(accepted(), district, middle)
        P.start_log(P.balance_stream(changes, -1000), path("balances"), path("cp/balances")).awaitTermination()

    def count(status):
        return lambda batch: seen.__setitem__(status, seen[status] + batch.count())

    approvals = P_stream(spark, path("approvals"), "type string, txn bigint, ts bigint, approved boolean")
    statuses = approvals.withColumn("status", F.when(F.col("approved"), "accepted").otherwise("rejected"))
    P.start_callbacks(statuses, {s: count(s) for s in seen}, path("cp/callbacks")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return ledger, path, seen


def P_stream(spark, folder, schema):
    return records.stream_log(spark, folder, schema)


def test_approvals_and_callbacks(spark, run):
    ledger, path, seen = run
    rejected = ledger.approvals.where("not approved").count()
    assert seen["rejected"] == rejected > 0
    assert seen["accepted"] == ledger.accepted.count() + ledger.shop.deliveries.count() + ledger.shop.payments.count()
    assert seen["written"] == 0


def test_stock_stream_equals_batch(spark, run):
    ledger, path, _ = run
    got = spark.read.parquet(path("stock"))
    columns = ["stock_w", "item", "ts", "txn", "line", "role", "level"]
    assert rows(got, *columns) == rows(ledger.moved.withColumn("level", F.col("level").cast("int")), *columns)


def test_district_stream_equals_batch(spark, run):
    ledger, path, _ = run
    got = spark.read.parquet(path("district"))
    assert rows(got.where("kind = 0"), "w", "d", "txn", "order_id") == rows(ledger.log_orders, "w", "d", "txn", "order_id")
    cents = F.col("total") * 100
    want = ledger.delivered.withColumn("total_cents", cents.cast("long"))
    columns = ["w", "d", "ts", "txn", "order_id", "c", "total_cents", "carrier"]
    assert rows(got.where("kind = 1"), *columns) == rows(want, *columns)


def test_balance_stream_ends_where_batch_ends(spark, run):
    ledger, path, _ = run
    got = spark.read.parquet(path("balances"))
    keys = ["w", "d", "c"]
    ends = got.groupBy(*keys).agg(F.sum("change_cents").alias("change"), F.count("*").alias("n"))
    want = ledger.current_balances.select(*keys, F.round(F.col("balance") * 100).cast("long").alias("cents"))
    assert rows(ends.select(*keys, (F.col("change") - 1000).alias("cents")), *keys, "cents") == rows(want, *keys, "cents")
    # every balance is one that the customer's changes in some order lead to, and the final one is among them
    reached = got.join(want, keys).where("balance_cents = cents").select(*keys).distinct()
    assert reached.count() == want.count()


def test_state_can_be_read_from_outside(spark, run):
    ledger, path, _ = run
    ends = P.read_state(spark, path("cp/district"), "ends").select("key.*", "value.*")
    placed = ledger.log_orders.groupBy("w", "d").agg((F.count("*") + 1).alias("next_id"))
    got = rows(ends.where("next_id > 1"), "w", "d", "next_id")
    assert got == rows(placed, "w", "d", "next_id")
    assert ends.agg(F.sum("pending")).first()[0] == ledger.pending.count()


def test_views_by_streaming_aggregates(spark, run, tmp_path):
    ledger, path, _ = run
    levels = P_stream(spark, path("stock"), "stock_w int, item bigint, ts bigint, txn bigint, line int, role string, level int")
    out = str(tmp_path / "view")
    P.start_view(
        P.view_stock(levels), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp")
    ).awaitTermination()
    got = spark.read.parquet(f"{out}/0")
    assert rows(got, "stock_w", "item", "level") == rows(
        ledger.levels.withColumn("level", F.col("level").cast("int")), "stock_w", "item", "level"
    )
    orders = P_stream(spark, path("district"), P.DISTRICT_LOG)
    latest = str(tmp_path / "latest")
    P.start_view(
        P.view_latest_orders(orders), lambda batch, n: batch.write.mode("overwrite").parquet(f"{latest}/{n}"), str(tmp_path / "cp2")
    ).awaitTermination()
    assert rows(spark.read.parquet(f"{latest}/0"), "w", "d", "c", "order_id") == rows(ledger.state, "w", "d", "c", "order_id")


def test_initial_state(spark, tmp_path):
    accepted = str(tmp_path / "accepted")
    spark.sql(
        "SELECT 'neworder' AS type, 1L AS txn, 5L AS ts, 3 AS w, 1 AS d, 7L AS c, "
        "array(named_struct('line', 0, 'item', 0L, 'supply_w', 3, 'quantity', 3), "
        "named_struct('line', 1, 'item', 1L, 'supply_w', 3, 'quantity', 5)) AS lines, "
        "CAST(NULL AS int) AS carrier, CAST(NULL AS string) AS last, CAST(NULL AS int) AS c_w, CAST(NULL AS int) AS c_d, "
        "CAST(NULL AS decimal(12,2)) AS amount, CAST(85.55 AS decimal(22,2)) AS total, 3 AS worker_w, 0 AS part"
    ).write.parquet(accepted)
    start = spark.createDataFrame([(3, 0, 50), (3, 1, 11)], "stock_w int, item long, level int")
    out = P.stock_stream(P_stream(spark, accepted, P.ACCEPTED), start)
    P.start_log(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "line", "role", "level") == [(0, "home", 47), (1, "home", 97)]


def test_stock_stream_of_any_quantity(spark, tmp_path):
    accepted, want, level = str(tmp_path / "accepted"), [], 12
    for i, quantities in enumerate([[200, 3], [92, 1, 1, 500], [0, 80, 2]]):
        lines = ", ".join(f"named_struct('line', {n}, 'item', 0L, 'supply_w', 3, 'quantity', {q})" for n, q in enumerate(quantities))
        spark.sql(
            f"SELECT 'neworder' AS type, {i}L AS txn, {i}L AS ts, 3 AS w, 1 AS d, 7L AS c, array({lines}) AS lines, "
            "CAST(NULL AS int) AS carrier, CAST(NULL AS string) AS last, CAST(NULL AS int) AS c_w, CAST(NULL AS int) AS c_d, "
            "CAST(NULL AS decimal(12,2)) AS amount, CAST(1 AS decimal(22,2)) AS total, 3 AS worker_w, 0 AS part"
        ).write.mode("append").parquet(accepted)
        start = spark.createDataFrame([(3, 0, 12)], "stock_w int, item long, level int")
        out = P.stock_stream(P_stream(spark, accepted, P.ACCEPTED), start)
        P.start_log(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        for n, q in enumerate(quantities):
            level = level - q + (91 if level - q < 10 else 0)
            want.append((i, n, level))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "txn", "line", "level") == sorted(want, key=repr)


def test_late_first_copies_pass(spark, tmp_path):
    hour = 3_600_000
    for i, part in enumerate([[(1, 9 * hour), (2, 10 * hour)], [(3, 11 * hour), (1, 9 * hour)], [(4, 5 * hour), (2, 10 * hour), (5, 12 * hour)]]):
        spark.createDataFrame(part, "txn long, ts long").write.mode("append").parquet(str(tmp_path / "log"))
        log = P_stream(spark, str(tmp_path / "log"), "txn long, ts long")
        P.start_log(P.without_duplicates(log, ["txn"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "txn") == [(1,), (2,), (3,), (4,), (5,)]


def test_a_request_sent_twice_is_decided_once(spark, tmp_path):
    order = (
        "SELECT 'neworder' AS type, 1L AS txn, 5L AS ts, 3 AS w, 1 AS d, 7L AS c, "
        "array(named_struct('line', 0, 'item', 0L, 'supply_w', 3, 'quantity', 2)) AS lines, CAST(NULL AS int) AS carrier, "
        "CAST(NULL AS string) AS last, CAST(NULL AS int) AS c_w, CAST(NULL AS int) AS c_d, CAST(NULL AS decimal(12,2)) AS amount"
    )
    items = spark.sql("SELECT 0L AS item, CAST(10.00 AS decimal(12,2)) AS price")
    at = {n: str(tmp_path / n) for n in ("requests", "accepted", "approvals", "cp")}
    for copies in (2, 1):  # twice in one batch, and again in a later one
        for _ in range(copies):
            spark.sql(order).write.mode("append").parquet(at["requests"])
        requests = P_stream(spark, at["requests"], P.REQUEST)
        P.start_verifier(requests, items, at["accepted"], at["approvals"], at["cp"]).awaitTermination()
    assert spark.read.parquet(at["approvals"]).count() == 1
    assert [float(r["total"]) for r in spark.read.schema(P.ACCEPTED).parquet(at["accepted"]).collect()] == [20.0]


def test_queue_stream_from_an_earlier_run(spark, tmp_path):
    accepted = str(tmp_path / "accepted")
    empty = "CAST(array() AS array<struct<line:int,item:bigint,supply_w:int,quantity:int>>) AS lines"
    rest = "CAST(NULL AS string) AS last, CAST(NULL AS int) AS c_w, CAST(NULL AS int) AS c_d, CAST(NULL AS decimal(12,2)) AS amount"
    spark.sql(
        f"SELECT 'delivery' AS type, t AS txn, t AS ts, 3 AS w, CAST(NULL AS int) AS d, CAST(NULL AS bigint) AS c, {empty}, 4 AS carrier, {rest}, "
        "CAST(NULL AS decimal(22,2)) AS total, 3 AS worker_w, 0 AS part FROM VALUES (1L), (2L), (3L) AS x(t)"
    ).write.parquet(accepted)
    start = spark.createDataFrame(
        [(3, 1, 6, 4, 70, 500), (3, 1, 6, 5, 71, 600), (3, 2, 9, None, None, None)],
        "w int, d int, next_id long, order_id long, c long, total_cents long",
    )
    out = P.district_stream(P_stream(spark, accepted, P.ACCEPTED), start)
    P.start_log(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "txn", "d", "order_id", "c", "total_cents")
    assert got == [(1, 1, 4, 70, 500), (2, 1, 5, 71, 600)]


def test_status_stream(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("requests", "approvals", "results", "cp", "view")}
    schema = {"requests": "type string, txn long", "approvals": "type string, txn long, approved boolean", "results": "type string, txn long"}
    steps = [
        ([("neworder", 1), ("neworder", 2), ("payment", 1), ("neworder", 3)], [("neworder", 1, True), ("neworder", 2, False)], []),
        ([("neworder", 4)], [("payment", 1, True), ("neworder", 1, True)], [("neworder", 1), ("payment", 1)]),
        ([], [], [("neworder", 3)]),  # a result before its approval
    ]
    seen = {}

    def upsert(batch, n):
        seen.update({(r.type, r.txn): r.status for r in batch.collect()})

    for step in steps:
        for name, part in zip(schema, step):
            spark.createDataFrame(part, schema[name]).write.mode("append").parquet(at[name])
        logs = [P_stream(spark, at[n], schema[n]) for n in schema]
        P.start_view(P.status_stream(*logs), upsert, at["cp"]).awaitTermination()
    assert seen == {
        ("neworder", 1): "complete", ("neworder", 2): "rejected", ("payment", 1): "complete", ("neworder", 3): "complete", ("neworder", 4): "written"
    }


def test_result_tail(spark, tmp_path):
    from tillroll.functions.keys import pack_txn

    at = str(tmp_path / "results")
    log = spark.createDataFrame([(1, 4, 10), (2, 4, 20), (3, 5, 30)], "serial int, connection int, ts long")
    log.select(pack_txn(F.col("serial"), F.col("connection")).alias("id"), "ts", "serial").write.parquet(at)
    tail = P.result_tail(P_stream(spark, at, "id long, ts long, serial int"), 4, 15)
    P.start_log(tail, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "serial") == [(2,)]


def test_timeout_stream(spark, tmp_path):
    sent, results = str(tmp_path / "sent"), str(tmp_path / "results")
    base = 1_600_000_000_000
    spark.createDataFrame([(1, base), (2, base), (3, base), (9, base + 3_600_000)], "txn bigint, sent bigint").write.parquet(sent)
    spark.createDataFrame(
        [(1, base + 1000), (2, base + 95_000), (9, base + 3_600_001), (10, base + 7_200_000)], "txn bigint, result bigint"
    ).write.parquet(results)
    out = P.timeout_stream(
        P_stream(spark, sent, "txn bigint, sent bigint"), P_stream(spark, results, "txn bigint, result bigint"), 90_000
    )
    P.start_log(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "txn") == [(2,), (3,)]
