"""Generated data keeps within its bounds and can be made again."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.functions import draws
from tillroll.functions.text import last_name
from tillroll.sources import generate as G

N = 20_000


def bounds(df, column):
    r = df.agg(F.min(column), F.max(column)).first()
    return r[0], r[1]


def share(df, condition):
    return df.agg(F.avg(condition.cast("int"))).first()[0]


def test_uniform_draws(spark):
    df = spark.range(N).select(
        draws.uniform(3, 9, 1, "id").alias("u"), draws.uniform_decimal(100, 999, 2, 2, "id").alias("m"),
        draws.nurand_draw(255, 10, 59, 3, "id").alias("n"), draws.chance(15, 4, "id").alias("p"),
    )
    assert bounds(df, "u") == (3, 9)
    assert df.groupBy("u").count().agg(F.min("count")).first()[0] > N / 7 * 0.9
    low, high = bounds(df, "m")
    assert 1 <= low < 1.2 and 9.8 < high <= 9.99
    assert bounds(df, "n") == (10, 59)
    assert abs(share(df, F.col("p")) - 0.15) < 0.02


def test_text_draws(spark):
    df = spark.range(N).select(draws.printable_text(6, 10, 1, "id").alias("a"), draws.digits(4, 4, 2, "id").alias("n"))
    assert bounds(df.select(F.length("a").alias("l")), "l") == (6, 10)
    assert df.where(~F.col("a").rlike("^[ -~]*$")).count() == 0
    assert df.where(~F.col("n").rlike("^[0-9]{4}$")).count() == 0
    assert df.select("a").distinct().count() > N * 0.99


def test_mix_of_transactions(spark):
    df = G.requests(spark, N, 5, 1)
    got = {r["type"]: r["count"] / N * 100 for r in df.groupBy("type").count().collect()}
    for name, percent in draws.MIX:
        assert abs(got[name] - percent) < 1.5
    edges = spark.createDataFrame([(0.0,), (4.2,), (8.4,), (12.6,), (55.8,), (99.9,)], "x double")
    assert [r[0] for r in edges.select(draws.transaction_type(F.col("x"))).collect()] == [
        "stocklevel", "orderstatus", "delivery", "payment", "neworder", "neworder"]


def test_random_tables(spark):
    ids = spark.range(1, 3001).select(F.col("id").alias("item"))
    items = G.items(ids, seed=5).cache()
    low, high = bounds(items, "price")
    assert low >= 0.01 and high <= 100
    assert bounds(items, "image")[0] >= 1 and bounds(items, "image")[1] <= 10000
    assert bounds(items.select(F.length("data").alias("l")), "l") == (26, 50)
    assert 0.07 < share(items, F.contains("data", F.lit("ORIGINAL"))) < 0.13
    homes = spark.range(1, 4).select(F.col("id").cast("int").alias("w"))
    tax = G.districts(homes, 10, seed=1).agg(F.min("tax"), F.max("tax"), F.count("*")).first()
    assert tax[0] >= 0 and tax[1] <= 0.2 and tax[2] == 30
    assert G.warehouses(homes, seed=2).where("not (length(name) between 6 and 10) or zip not rlike '^[0-9]{4}11111$'").count() == 0
    stock = G.stock(ids, 2, seed=3)
    assert stock.count() == 6000 and bounds(stock, "quantity") == (10, 100)
    assert stock.where("length(dist_07) <> 24").count() == 0


def test_random_customers(spark):
    keys = G.keys(spark, 2, 3, 300)
    people = G.customers(keys, names=100, seed=8).cache()
    assert people.count() == 1800
    first = people.where("c <= 100").select("c", "last", last_name(F.col("c") - 1).alias("want"))
    assert first.where("last <> want").count() == 0
    allowed = spark.range(100).select(last_name(F.col("id")).alias("last"))
    assert people.join(allowed, "last", "left_anti").count() == 0
    assert 0.07 < share(people, F.col("credit") == "BC") < 0.13
    assert people.where("balance <> -100 or length(data) not between 300 and 500 or length(phone) <> 16").count() == 0


@pytest.mark.parametrize("seed", [None, 11])
def test_population(spark, tmp_path, seed):
    at = str(tmp_path)
    G.populate(spark, at, n_warehouses=2, n_districts=3, n_customers=20, n_items=15, names=5, seed=seed)
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    sizes = {n: read(n).count() for n in ["item", "warehouse", "district", "stock", "customer", "order", "next_order_id"]}
    assert sizes == {"item": 15, "warehouse": 2, "district": 6, "stock": 30, "customer": 120, "order": 120, "next_order_id": 6}
    assert rows(read("next_order_id").select("next_id").distinct(), "next_id") == [(21,)]
    lines = read("order_line")
    assert bounds(lines, "item")[0] >= 1 and bounds(lines, "item")[1] <= 15
    counts = lines.groupBy("w", "d", "order_id").count()
    assert counts.where("count not between 5 and 15").count() == 0
    waiting = read("pending")
    assert waiting.count() == (0 if seed is None else 36)
    assert read("order").where("carrier is null").count() == waiting.count()
    if seed is not None:
        # each customer has one order, not in customer order; the pending ones are the newest
        assert read("order").select("w", "d", "c").distinct().count() == 120
        assert read("order").where("c <> order_id").count() > 0
        assert waiting.where("order_id <= 14").count() == 0
        total = lines.groupBy("w", "d", "order_id").agg(F.sum("amount").alias("t"))
        assert waiting.join(total, ["w", "d", "order_id"]).where("t <> total").count() == 0
    before = read("stock").agg(F.sum("quantity")).first()[0]
    G.populate(spark, at, 2, 3, 20, 15, 5, seed=seed, with_shared=False)
    assert read("stock").agg(F.sum("quantity")).first()[0] == before
    assert read("customer").count() == 120


def test_requests(spark):
    asked = G.requests(spark, N, 4, 3)
    new = G.new_order_requests(asked, 300, 10, 5)
    assert bounds(new, "c") == (1, 300) and bounds(new, "d") == (1, 10) and bounds(new, "n_lines") == (5, 15)
    assert abs(share(new, F.col("spoiled")) - 0.01) < 0.004
    lines = G.new_order_request_lines(new, 1000, 4, 7)
    assert abs(share(lines, F.col("supply_w") != F.col("w")) - 0.01) < 0.003
    assert bounds(lines, "quantity") == (1, 10)
    known = lines.where(F.col("item") != G.UNUSED_ITEM)
    assert bounds(known, "item")[0] >= 1 and bounds(known, "item")[1] <= 1000
    paid = G.payment_requests(asked, 4, 10, 300, 50, 9)
    assert abs(share(paid, F.col("c_w") != F.col("w")) - 0.15) < 0.02
    assert abs(share(paid, F.col("last").isNotNull()) - 0.6) < 0.02
    assert paid.where("(c is null) = (last is null)").count() == 0
    low, high = bounds(paid, "amount")
    assert low >= 1 and high <= 50000
    assert bounds(G.delivery_requests(asked, 1), "carrier") == (1, 10)
    assert bounds(G.stock_level_requests(asked, 10, 1), "threshold") == (10, 20)
    assert abs(share(G.order_status_requests(asked, 300, 10, 50, 1), F.col("c").isNull()) - 0.6) < 0.02


def test_draws_depend_on_seed_and_key_only(spark):
    def table(partitions, seed):
        ids = spark.range(0, 3000, 1, partitions)
        return ids.select(
            "id", draws.uniform(1, 10**6, seed, "id").alias("u"), draws.printable_text(1, 40, seed + 1, "id").alias("t"),
            draws.digits(1, 9, seed + 3, "id", F.lit(7)).alias("n"),
        )

    few, many = (rows(table(n, 5), "id", "u", "t", "n") for n in (3, 30))
    assert few == many
    assert few != rows(table(3, 6), "id", "u", "t", "n")
    # one row alone is the same row
    alone = table(1, 5).where("id = 1234")
    assert rows(alone, "id", "u", "t", "n") == [r for r in few if r[0] == 1234]
    # neighbouring keys and seeds do not go together
    pairs = spark.range(N).select(draws.unit(1, "id").alias("a"), draws.unit(2, "id").alias("b"), draws.unit(1, F.col("id") + 1).alias("c"))
    assert max(abs(x) for x in pairs.agg(F.corr("a", "b"), F.corr("a", "c")).first()) < 0.03
    with pytest.raises(ValueError):
        draws.uniform(1, 2, 3)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_shuffle_is_one_to_one(spark, n):
    df = spark.range(n).select("id", *(draws.permuted(F.col("id"), F.lit(n), s, F.lit(g)).alias(f"p{s}_{g}") for s in (1, 3) for g in (1, 2)))
    got = df.toPandas()
    for name in got.columns:
        assert sorted(got[name]) == list(range(n))
    if n == 1000:
        assert (got["p1_1"] == got["id"]).mean() < 0.02
        assert (got["p1_1"] != got["p1_2"]).mean() > 0.98 and (got["p1_1"] != got["p3_1"]).mean() > 0.98
        assert abs(got["id"].corr(got["p1_1"])) < 0.12


def test_orders_of_dense_customers(spark):
    keys = G.keys(spark, 2, 3, 50)
    for seed in (None, 4):
        ranked, dense = (rows(G.orders(keys.repartition(n), seed=seed, dense=d), "w", "d", "c", "order_id", "n_lines", "entered", "carrier")
                         for n, d in ((3, False), (30, True)))
        assert ranked == dense
    plan = G.orders(keys, seed=4, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    with pytest.raises(Exception, match="not 1..n"):
        G.orders(keys.where("c <> 7"), seed=4, dense=True).collect()


@pytest.mark.parametrize("partitions", [3, 30])
def test_population_again(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        G.populate(spark, f"{tmp_path}/a", 2, 2, 12, 9, 5, seed=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    G.populate(spark, f"{tmp_path}/b", 2, 2, 12, 9, 5, seed=3)
    for name in ("item", "warehouse", "district", "stock", "customer", "order", "order_line", "pending"):
        a, b = (spark.read.parquet(f"{tmp_path}/{x}/{name}") for x in "ab")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
