"""Generated data: the initial population and request tables.

Two forms of each table, as columns over a DataFrame of keys: predictable (values
follow from the key, for tests) and random (draws by seed and key within the TPC-C bounds). Random times
are the caller's ``now_ms``, so the same arguments make the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import draws
from tillroll.functions.text import customer_data, last_name, predictable_address, with_original
from tillroll.operators.scan import running
from tillroll.sources.shop import CREDIT_LIMIT, DISTRICTS, MONEY, RATE, SINCE_MS, initial_stock

# Time of order 0, milliseconds between orders, quantity of every
# generated line, opening balance, and the share delivered beforehand (tenths).
ORDER_BASE_MS = 1546300800000
ORDER_STEP_MS = 1000
LINE_QUANTITY = 5
GENERATED_BALANCE = "-100.00"
DELIVERED_TENTHS = 7
UNUSED_ITEM = 2**31 - 1


def text(column: Column) -> Column:
    return column.cast("string")


def _random_address(seed: int, key: tuple[str, ...]) -> dict[str, Column]:
    return {
        "street1": draws.printable_text(10, 20, seed, *key),
        "street2": draws.printable_text(10, 20, seed + 2, *key),
        "city": draws.printable_text(10, 20, seed + 4, *key),
        "state": draws.printable_text(2, 2, seed + 6, *key),
        "zip": F.concat(draws.digits(4, 4, seed + 8, *key), F.lit("11111")),
    }


def _address(kind: str, number: Column, seed: int | None, *key: str) -> list[Column]:
    parts = predictable_address(kind, number) if seed is None else _random_address(seed, key)
    return [value.alias(name) for name, value in parts.items()]


def _random_data(keys: DataFrame, seed: int, *key: str) -> DataFrame:
    """``data``: 26..50 characters, one in ten with ORIGINAL written over eight of them."""
    drawn = keys.withColumn("_text", draws.printable_text(26, 50, seed, *key))
    position = F.floor(draws.unit(seed + 2, *key) * (F.length("_text") - 8))
    return drawn.withColumn(
        "data", F.when(draws.chance(10, seed + 3, *key), with_original(F.col("_text"), position)).otherwise(F.col("_text"))
    ).drop("_text")


def items(ids: DataFrame, seed: int | None = None) -> DataFrame:
    """item, image, name, price, data for each ``item``."""
    i = F.col("item")
    if seed is None:
        return ids.select(
            "item",
            (i % 10000 + 1).alias("image"),
            F.concat(F.lit("Item number "), text(i)).alias("name"),
            (i + (i % 100) / F.lit(100)).cast(MONEY).alias("price"),
            F.concat(F.lit("Data for item number "), text(i)).alias("data"),
        )
    return _random_data(ids, seed, "item").select(
        "item",
        draws.uniform(1, 10000, seed + 4, "item").alias("image"),
        draws.printable_text(14, 24, seed + 5, "item").alias("name"),
        draws.uniform_decimal(1, 10000, 2, seed + 7, "item").cast(MONEY).alias("price"),
        "data",
    )


def warehouses(ids: DataFrame, seed: int | None = None) -> DataFrame:
    w = F.col("w")
    if seed is None:
        name, tax = F.concat(F.lit("WHOUSE"), text(w)), (w % 200 / F.lit(1000))
    else:
        name, tax = draws.printable_text(6, 10, seed, "w"), draws.uniform_decimal(0, 2000, 4, seed + 2, "w")
    address = _address("WAREHOUSE", w, None if seed is None else seed + 3, "w")
    return ids.select("w", name.alias("name"), *address, tax.cast(RATE).alias("tax"))


def districts(ids: DataFrame, per_warehouse: int = DISTRICTS, seed: int | None = None) -> DataFrame:
    """Districts 1..per_warehouse of each ``w``."""
    keys = ids.select("w", F.explode(F.sequence(F.lit(1), F.lit(per_warehouse))).alias("d"))
    d = F.col("d")
    if seed is None:
        name, tax = F.concat(F.lit("DISTR-"), text(d)), (d % 20 / F.lit(100))
    else:
        name, tax = draws.printable_text(6, 10, seed, "w", "d"), draws.uniform_decimal(0, 2000, 4, seed + 2, "w", "d")
    address = _address("DISTRICT", d, None if seed is None else seed + 3, "w", "d")
    return keys.select("w", "d", name.alias("name"), *address, tax.cast(RATE).alias("tax"))


def customers(keys: DataFrame, names: int, seed: int | None = None, now_ms: int = ORDER_BASE_MS) -> DataFrame:
    """Customers for each (w, d, c); last names come from a range of ``names``."""
    c, w, d = F.col("c"), F.col("w"), F.col("d")
    if seed is None:
        last = last_name(F.pmod(c - 1, F.lit(names)))
        values = [
            F.concat(text(c), F.lit("-FIRSTNAME")).alias("first"),
            last.alias("last"),
            *_address("CUSTOMER", c, None),
            F.lpad(text(c), 16, "0").alias("phone"),
            F.lit(SINCE_MS).alias("since"),
            F.when(c % 10 == 0, "BC").otherwise("GC").alias("credit"),
            (c % 6 / F.lit(10000)).cast(RATE).alias("discount"),
            customer_data(c, w, d).alias("data"),
        ]
        drawn = keys
    else:
        # a column of its own: the name uses it three times
        drawn = keys.withColumn("_name", draws.nurand_draw(255, 0, names - 1, seed, "w", "d", "c"))
        last = last_name(F.when(c <= names, c - 1).otherwise(F.col("_name")))
        values = [
            draws.printable_text(8, 16, seed + 2, "w", "d", "c").alias("first"),
            last.alias("last"),
            *_address("CUSTOMER", c, seed + 4, "w", "d", "c"),
            draws.digits(16, 16, seed + 20, "w", "d", "c").alias("phone"),
            F.lit(now_ms).alias("since"),
            F.when(draws.chance(90, seed + 22, "w", "d", "c"), "GC").otherwise("BC").alias("credit"),
            draws.uniform_decimal(0, 5000, 4, seed + 23, "w", "d", "c").cast(RATE).alias("discount"),
            draws.printable_text(300, 500, seed + 24, "w", "d", "c").alias("data"),
        ]
    return drawn.select(
        "w", "d", "c", F.lit("OE").alias("middle"), *values,
        F.lit(CREDIT_LIMIT).cast(MONEY).alias("credit_limit"),
        F.lit(GENERATED_BALANCE).cast(MONEY).alias("balance"),
    )


def stock_keys(ids: DataFrame, n_warehouses: int) -> DataFrame:
    """Each item in each warehouse 1..n."""
    return ids.select("item", F.explode(F.sequence(F.lit(1), F.lit(n_warehouses))).alias("w"))


def stock(ids: DataFrame, n_warehouses: int, seed: int | None = None) -> DataFrame:
    """Each item in each warehouse 1..n: quantity, ten district texts, data."""
    keys = stock_keys(ids, n_warehouses)
    i = F.col("item")
    if seed is None:
        dist = [F.lpad(text(i), 24, "0")] * DISTRICTS
        full, quantity = keys.withColumn("data", F.concat(F.lit("Data for stock number "), text(i))), initial_stock(i)
    else:
        dist = [draws.printable_text(24, 24, seed + 10 + 2 * n, "w", "item") for n in range(DISTRICTS)]
        full, quantity = _random_data(keys, seed, "w", "item"), draws.uniform(10, 100, seed + 5, "w", "item").cast("int")
    return full.select(
        "w", "item", quantity.alias("quantity"),
        *[x.alias(f"dist_{n:02d}") for n, x in enumerate(dist, 1)], "data",
    )


def stock_texts(w: Column, item: Column) -> Column:
    """District texts 1..10 of a stock row, each naming warehouse, district and item."""
    return F.array(*[_stock_text(w, item, F.lit(n)) for n in range(1, DISTRICTS + 1)])


def _stock_text(w: Column, item: Column, d: Column) -> Column:
    return F.rpad(F.concat_ws(".", text(w), text(d), text(item)), 24, "*")


def stock_text(w: Column, item: Column, d: Column) -> Column:
    """The element ``d`` of ``stock_texts``, without making the others."""
    return F.when(d.between(1, DISTRICTS), _stock_text(w, item, d)).otherwise(F.element_at(stock_texts(w, item), d))


def orders(
    keys: DataFrame, delivered_tenths: int = DELIVERED_TENTHS, seed: int | None = None, now_ms: int = ORDER_BASE_MS,
    dense: bool = False, **bounds,
) -> DataFrame:
    """One order per customer (w, d, c): number, time, line count, carrier if delivered.

    Customers get numbers in id order (predictable) or in shuffled order (random);
    the first ``delivered_tenths`` tenths of each district are delivered already.
    ``dense`` says that each district's customers are 1..n, so that no window has to rank
    them; a district whose customers are not raises.
    """
    per_district = keys.groupBy("w", "d").agg(
        F.count("*").alias("_n"), ((F.min("c") == 1) & (F.max("c") == F.count("*"))).alias("_dense")
    )
    if dense:
        checked = F.when(F.col("_dense"), F.col("c")).otherwise(F.raise_error(F.lit("customers of a district are not 1..n")))
        ranked = keys.join(per_district, ["w", "d"]).withColumn("order_id", checked.cast("long"))
    else:
        ranked = running(keys, ["w", "d"], ["c"], {"order_id": F.lit(1)}, **bounds).join(per_district, ["w", "d"])
    if seed is None:
        lines, carrier = F.col("order_id") % 11 + 5, F.col("order_id") % 10 + 1
        entered = F.col("order_id") * ORDER_STEP_MS + ORDER_BASE_MS
    else:
        ranked = ranked.withColumn("order_id", draws.permuted(F.col("order_id") - 1, F.col("_n"), seed + 2, "w", "d") + 1)
        by = ("w", "d", "order_id")
        lines, carrier = draws.uniform(5, 15, seed, *by), draws.uniform(1, 10, seed + 1, *by)
        entered = F.lit(now_ms)
    done = F.col("order_id") * 10 <= F.col("_n") * delivered_tenths
    return (
        ranked.withColumns({"n_lines": lines.cast("int"), "entered": entered, "delivered": done, "_carrier": carrier})
        .withColumn("carrier", F.when(F.col("delivered"), F.col("_carrier")).cast("int"))
        .drop("_n", "_dense", "_carrier")
    )


def order_lines(
    headers: DataFrame, n_items: int, seed: int | None = None, stock_level: Callable[[Column], Column] = initial_stock
) -> DataFrame:
    """Lines of generated orders. Delivered ones cost nothing; the amount of a pending
    one is its order number plus a cent per line (predictable) or drawn (random).
    ``stock_level`` gives the home level of an item."""
    lines = headers.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)))
    if seed is None:
        item = F.pmod(F.col("order_id") * 10 + F.col("line") - 1, F.lit(n_items)) + 1
        amount = F.col("order_id") + F.col("line") / F.lit(100)
        info = F.rpad(F.concat_ws(".", *[text(F.col(x)) for x in ("w", "d", "order_id", "line")]), 24, "*")
    else:
        by = ("w", "d", "order_id", "line")
        item, amount = draws.uniform(1, n_items, seed, *by), draws.uniform_decimal(1, 999999, 2, seed + 1, *by)
        info = draws.printable_text(24, 24, seed + 2, *by)
    return lines.withColumn("item", item).select(
        "w", "d", "order_id", "line", "item",
        stock_level(F.col("item")).alias("home_level"),
        F.col("w").alias("supply_w"),
        F.lit(LINE_QUANTITY).alias("quantity"),
        F.when(F.col("delivered"), F.lit(0)).otherwise(amount).cast(MONEY).alias("amount"),
        F.when(F.col("delivered"), F.col("entered")).alias("delivery_ms"),
        info.alias("dist_info"),
    )


def keys(spark: SparkSession, n_warehouses: int, n_districts: int, n_customers: int) -> DataFrame:
    """All (w, d, c): one number per customer, taken apart."""
    n = F.col("id")
    return spark.range(n_warehouses * n_districts * n_customers).select(
        (F.floor(n / (n_districts * n_customers)) + 1).cast("int").alias("w"),
        (F.floor(n / n_customers) % n_districts + 1).cast("int").alias("d"),
        (n % n_customers + 1).alias("c"),
    )


def populate(
    spark: SparkSession,
    folder: str,
    n_warehouses: int,
    n_districts: int,
    n_customers: int,
    n_items: int,
    names: int,
    seed: int | None = None,
    with_shared: bool = True,
    now_ms: int = ORDER_BASE_MS,
) -> None:
    """Write the whole initial population, one folder per table.

    Predictable data (no ``seed``) has all its orders delivered. ``with_shared=False``
    leaves the tables that never change alone. ``now_ms`` is the time of random orders and customers. Running it again replaces the tables.
    """
    ids = spark.range(1, n_items + 1).select(F.col("id").alias("item"))
    homes = spark.range(1, n_warehouses + 1).select(F.col("id").cast("int").alias("w"))
    everyone = keys(spark, n_warehouses, n_districts, n_customers)
    tenths = 10 if seed is None else DELIVERED_TENTHS

    def at(n):
        return None if seed is None else seed + 1000 * n

    def write(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")

    if with_shared:
        write(items(ids, at(1)), "item")
        write(warehouses(homes, at(2)).withColumn("ytd", F.lit("300000.00").cast(MONEY)), "warehouse")
        write(districts(homes, n_districts, at(3)).withColumn("ytd", F.lit("30000.00").cast(MONEY)), "district")
    write(stock(ids, n_warehouses, at(4)), "stock")
    write(
        customers(everyone, names, at(5), now_ms).withColumns(
            {"ytd_payment": F.lit("10.00").cast(MONEY), "payment_count": F.lit(1), "delivery_count": F.lit(0)}
        ),
        "customer",
    )
    # line counts are drawn once, in the written headers; lines are made from those
    write(orders(everyone, tenths, at(6), now_ms, dense=True), "order")
    headers = spark.read.parquet(f"{folder}/order")
    write(order_lines(headers, n_items, at(7)), "order_line")
    lines = spark.read.parquet(f"{folder}/order_line")
    totals = lines.groupBy("w", "d", "order_id").agg(F.sum("amount").alias("total"))
    write(headers.where("not delivered").join(totals, ["w", "d", "order_id"]).select("w", "d", "order_id", "c", "total"), "pending")
    write(headers.groupBy("w", "d").agg((F.max("order_id") + 1).alias("next_id")), "next_order_id")


# ---- request tables ----------------------------------------------------------


def _other_warehouse(own: Column, n_warehouses: int, seed: int, *key: str) -> Column:
    """Uniform among the other warehouses; the own one if there is no other."""
    if n_warehouses == 1:
        return own
    drawn = draws.uniform(1, n_warehouses - 1, seed, *key)
    return (F.pmod(own - 1 + drawn, F.lit(n_warehouses)) + 1).cast("int")


def requests_for(ids: DataFrame, n_warehouses: int, seed: int) -> DataFrame:
    """A request with type and home warehouse for each ``txn``: txn, type, w."""
    return ids.select(
        "txn",
        draws.transaction_type(draws.unit(seed, "txn") * 100).alias("type"),
        (F.pmod(F.col("txn"), F.lit(n_warehouses)) + 1).cast("int").alias("w"),
    )


def requests(spark: SparkSession, n: int, n_warehouses: int, seed: int) -> DataFrame:
    """n requests, txn 0..n-1: txn, type, w."""
    return requests_for(spark.range(n).withColumnRenamed("id", "txn"), n_warehouses, seed)


def new_order_requests(asked: DataFrame, n_customers: int, n_districts: int, seed: int) -> DataFrame:
    """txn, w -> + d, c, n_lines, and whether the last item is to be unknown (1%)."""
    return asked.withColumns(
        {
            "d": draws.uniform(1, n_districts, seed, "txn").cast("int"),
            "c": draws.nurand_draw(1023, 1, n_customers, seed + 1, "txn"),
            "n_lines": draws.uniform(5, 15, seed + 3, "txn").cast("int"),
            "spoiled": draws.chance(1, seed + 4, "txn"),
        }
    )


def new_order_request_lines(new_orders: DataFrame, n_items: int, n_warehouses: int, seed: int) -> DataFrame:
    """Lines: item, 1% supplied by another warehouse, quantity 1..10."""
    lines = new_orders.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)))
    last = F.col("spoiled") & (F.col("line") == F.col("n_lines") - 1)
    remote = draws.chance(1, seed + 2, "txn", "line")
    return lines.select(
        "txn", "w", "line",
        F.when(last, F.lit(UNUSED_ITEM)).otherwise(draws.nurand_draw(8191, 1, n_items, seed, "txn", "line")).cast("long").alias("item"),
        F.when(remote, _other_warehouse(F.col("w"), n_warehouses, seed + 3, "txn", "line")).otherwise(F.col("w")).alias("supply_w"),
        draws.uniform(1, 10, seed + 4, "txn", "line").cast("int").alias("quantity"),
    )


def payment_requests(
    asked: DataFrame, n_warehouses: int, n_districts: int, n_customers: int, names: int, seed: int,
    cents: tuple[int, int] = (100, 5000000),
) -> DataFrame:
    """15% of the customers belong to another warehouse; 60% are named, not numbered."""
    drawn = asked.withColumns(
        {
            "d": draws.uniform(1, n_districts, seed, "txn").cast("int"),
            "_remote": draws.chance(15, seed + 1, "txn"),
            "_named": draws.chance(60, seed + 2, "txn"),
            "_name": draws.nurand_draw(255, 0, names - 1, seed + 3, "txn"),
            "_other": _other_warehouse(F.col("w"), n_warehouses, seed + 5, "txn"),
            "_other_d": draws.uniform(1, n_districts, seed + 6, "txn").cast("int"),
            "_c": draws.nurand_draw(1023, 1, n_customers, seed + 7, "txn"),
            "amount": draws.uniform_decimal(*cents, 2, seed + 9, "txn").cast(MONEY),
        }
    )
    return drawn.select(
        "txn", "w", "d", "amount",
        F.when(F.col("_remote"), F.col("_other")).otherwise(F.col("w")).alias("c_w"),
        F.when(F.col("_remote"), F.col("_other_d")).otherwise(F.col("d")).alias("c_d"),
        F.when(~F.col("_named"), F.col("_c")).alias("c"),
        F.when(F.col("_named"), last_name(F.col("_name"))).alias("last"),
    )


def delivery_requests(asked: DataFrame, seed: int) -> DataFrame:
    return asked.withColumn("carrier", draws.uniform(1, 10, seed, "txn").cast("int"))


def stock_level_requests(asked: DataFrame, n_districts: int, seed: int) -> DataFrame:
    return asked.withColumns(
        {
            "d": draws.uniform(1, n_districts, seed, "txn").cast("int"),
            "threshold": draws.uniform(10, 20, seed + 1, "txn").cast("int"),
        }
    )


def order_status_requests(asked: DataFrame, n_customers: int, n_districts: int, names: int, seed: int) -> DataFrame:
    drawn = asked.withColumns(
        {
            "d": draws.uniform(1, n_districts, seed, "txn").cast("int"),
            "_named": draws.chance(60, seed + 1, "txn"),
            "_name": draws.nurand_draw(255, 0, names - 1, seed + 2, "txn"),
            "_c": draws.nurand_draw(1023, 1, n_customers, seed + 4, "txn"),
        }
    )
    return drawn.select(
        "txn", "w", "d",
        F.when(~F.col("_named"), F.col("_c")).alias("c"),
        F.when(F.col("_named"), last_name(F.col("_name"))).alias("last"),
    )
