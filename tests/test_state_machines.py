"""The closed forms against the state machines they stand for."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.operators import accounts, queue, stock


def take(level, quantity):
    left = level - quantity
    return left + 91 if left < 10 else left


def test_level_after_many_lines(spark):
    rng = random.Random(3)
    cases, want = [], []
    for n in range(400):
        start = rng.choice([rng.randrange(10, 101), rng.randrange(0, 300)])
        level, total = start, 0
        for step in range(rng.randrange(1, 12)):
            quantity = rng.randrange(1, 82)
            level, total = take(level, quantity), total + quantity
            cases.append((n, step, start, total))
            want.append((n, step, level))
    df = spark.createDataFrame(cases, "n int, step int, start int, total int")
    got = df.select("n", "step", stock.level_after(F.col("start"), F.col("total")).alias("level"))
    assert rows(got, "n", "step", "level") == sorted(want, key=repr)


def test_quantity_out_of_range_raises(spark):
    lines = spark.createDataFrame([(1, 1, 0, 5, 1, 1, 92)], "txn int, ts int, line int, item int, w int, supply_w int, quantity int")
    with pytest.raises(Exception, match="quantity out of range: 92"):
        stock.movements(lines).collect()


@pytest.mark.parametrize("hot_rows", [100_000, 25])
def test_levels_of_any_quantity(spark, hot_rows):
    """Quantities that one restocking does not make up for, looks in between, any opening level."""
    rng = random.Random(11)
    lines, starts, want, last = [], [], [], []
    for item in range(12):
        level = rng.choice([0, 5, 10, 50, 100, 400])
        starts.append((1, item, level))
        for ts in range(60):
            quantity, look = rng.choice([0, 1, 5, 80, 91, 92, 200, 1000]) if rng.random() < 0.6 else 3, rng.random() < 0.2
            lines.append((ts, ts, 0, item, 1, 2 if look else 1, quantity))
            level = level if look else take(level, quantity)
            want.append((item, ts, level))
        last.append((item, level))
    df = spark.createDataFrame(lines, "txn int, ts int, line int, item int, w int, supply_w int, quantity int")
    moved = stock.movements(df, any_quantity=True).where("stock_w = 1")
    start = spark.createDataFrame(starts, "stock_w int, item int, start_level int")
    spark.conf.set("tillroll.hotRows", str(hot_rows))
    try:
        got = rows(stock.with_levels(moved, start, any_quantity=True), "item", "ts", "level")
        ends = rows(stock.current_levels(moved, start, any_quantity=True), "item", "level")
    finally:
        spark.conf.unset("tillroll.hotRows")
    assert got == sorted(want, key=repr) and ends == sorted(last, key=repr)


@pytest.mark.parametrize("hot_rows", [100_000, 25])
def test_queue_against_a_real_queue(spark, hot_rows):
    rng = random.Random(5)
    events, want = [], []
    starts = {(1, 1): (8, 3), (1, 2): (1, 0)}
    for (w, d), (next_id, n) in starts.items():
        waiting = deque(range(next_id - n, next_id))
        for ts in range(120):
            if rng.random() < 0.45:
                events.append((w, d, ts, 0, ts))
                waiting.append(next_id)
                want.append((d, ts, 0, next_id))
                next_id += 1
            else:
                events.append((w, d, ts, 1, ts))
                want.append((d, ts, 1, waiting.popleft() if waiting else None))
    log = spark.createDataFrame(events, "w int, d int, ts int, kind int, txn int")
    orders = log.where("kind = 0").select("w", "d", "ts", "txn", F.lit(7).alias("c"), F.lit(1).cast("decimal(22,2)").alias("total"))
    start = spark.createDataFrame([(w, d, n, p) for (w, d), (n, p) in starts.items()], "w int, d int, next_id int, pending int")
    # every district is polled by its own deliveries here, so the polls are filtered back to them
    polled = log.where("kind = 1").select(F.col("w"), "ts", "txn", F.lit(1).alias("carrier"), F.col("d").alias("only"))
    spark.conf.set("tillroll.hotRows", str(hot_rows))
    try:
        out = []
        for d in (1, 2):
            got = queue.district_log(
                orders.where(F.col("d") == d), polled.where(F.col("only") == d).drop("only"), start.where(F.col("d") == d)
            )
            out += rows(got.where(F.col("d") == d), "d", "ts", "kind", "order_id")
    finally:
        spark.conf.unset("tillroll.hotRows")
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_bad_credit_text_is_cut_like_a_fold(spark):
    rng = random.Random(9)
    start, payments, want = "s" * 480, [], []
    text = start
    for i in range(150):
        amount = f"{rng.randrange(1, 999999) / 100:.2f}"
        payments.append((i, i, 11, 3, 2, 4, 5, amount))
        text = (f"1132{4}{5}{amount}" + text)[:500]
        want.append((i, text))
    df = spark.createDataFrame(payments, "txn int, ts int, c int, c_d int, c_w int, d int, w int, amount string").withColumn(
        "amount", F.col("amount").cast("decimal(12,2)")
    )
    customer = spark.createDataFrame([(11, 3, 2, "BC", start)], "c int, d int, w int, credit string, opening_data string")
    got = accounts.credit_data(df, customer)
    assert rows(got, "txn", "data") == sorted(want, key=repr)
    assert accounts.current_credit_data(df, customer).first().data == text
