"""The order-entry logs and tables, as read from a folder of parquet tables.

Every method returns a lazy DataFrame; columns nobody asks for are pruned at the scan.
Short column names: ``w`` warehouse, ``d`` district, ``c`` customer, ``txn``
transaction, ``ts`` log time in epoch milliseconds. The log's order is
(ts, kind, txn): new orders before deliveries before payments at the same time.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.text import customer_data, last_name, predictable_address
from tillroll.operators.scan import running
from tillroll.sources.tables import SCHEMAS

MONEY = "decimal(12,2)"
RATE = "decimal(5,4)"
DISTRICTS = 10
NEW_ORDER, DELIVERY, PAYMENT = 0, 1, 2

# Since-date, credit limit and opening balance of a generated customer.
SINCE_MS = 1514764800000
CREDIT_LIMIT = "50000.00"
OPENING_BALANCE = "-10.00"

# payments are spread over the order period: log time = 1995-01-01 + 80 x time since 2024-01-01
PAYMENT_BASE_MS = 788918400000
EVENT_BASE_MS = 1704067200000
PAYMENT_STRETCH = 80


def epoch_ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def home(nation: str) -> Column:
    return (F.col(nation) + 1).cast("int")


def home_district(customer: str) -> Column:
    return (F.col(customer) % DISTRICTS + 1).cast("int")


def initial_stock(item: Column) -> Column:
    """Stock before the first movement, for items nobody set otherwise."""
    return (item % 90 + 10).cast("int")


class Shop:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def rows(self, *names: str) -> int:
        """Rows of the named tables together; Spark answers this from the file footers."""
        for name in names:
            if name not in self._rows:
                self._rows[name] = self.table(name).count()
        return sum(self._rows[name] for name in names)

    # ---- shared tables -------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").where("p_partkey % 100 <> 99").select(
            F.col("p_partkey").alias("item"),
            F.col("p_name").alias("item_name"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = F.col("c_custkey")
        w, d = home("c_nationkey"), home_district("c_custkey")
        return self.table("customer").select(
            c.alias("c"),
            d.alias("d"),
            w.alias("w"),
            F.col("c_name").alias("first"),
            F.lit("OE").alias("middle"),
            last_name(c % 20).alias("last"),
            *[v.alias(f"c_{k}") for k, v in predictable_address("CUSTOMER", c).items()],
            F.lpad(c.cast("string"), 16, "0").alias("phone"),
            F.lit(SINCE_MS).alias("since"),
            F.when(F.floor(c / 10) % 10 == 0, "BC").otherwise("GC").alias("credit"),
            F.lit(CREDIT_LIMIT).cast(MONEY).alias("credit_limit"),
            (c % 6 / F.lit(10000)).cast(RATE).alias("discount"),
            F.lit(OPENING_BALANCE).cast(MONEY).alias("opening_balance"),
            customer_data(c, w, d).alias("opening_data"),
        )

    @cached_property
    def warehouses(self) -> DataFrame:
        w = home("n_nationkey")
        return self.table("nation").select(
            w.alias("w"),
            F.concat(F.lit("WHOUSE"), w.cast("string")).alias("w_name"),
            *[v.alias(f"w_{k}") for k, v in predictable_address("WAREHOUSE", w).items()],
            (w % 200 / F.lit(1000)).cast(RATE).alias("w_tax"),
        )

    @cached_property
    def districts(self) -> DataFrame:
        w, d = home("n_nationkey"), F.col("d")
        return (
            self.table("nation")
            .select(w.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(DISTRICTS))).alias("d"))
            .select(
                "w",
                "d",
                F.concat(F.lit("DISTR-"), d.cast("string")).alias("d_name"),
                *[v.alias(f"d_{k}") for k, v in predictable_address("DISTRICT", d).items()],
                (d % 20 / F.lit(100)).cast(RATE).alias("d_tax"),
            )
        )

    # ---- new-order requests --------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        """One new-order request per row: txn, ts, c, d, w."""
        homes = self.table("customer").select(F.col("c_custkey").alias("c"), home("c_nationkey").alias("w"))
        return (
            self.table("orders")
            .select(
                F.col("o_orderkey").alias("txn"),
                epoch_ms("o_orderdate").alias("ts"),
                F.col("o_custkey").alias("c"),
                home_district("o_custkey").alias("d"),
            )
            .join(homes, "c")
        )

    @cached_property
    def bare_lines(self) -> DataFrame:
        """Order lines without number or default supplier (null: the home warehouse)."""
        suppliers = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), home("s_nationkey").alias("remote_w")
        )
        quantity = (F.col("l_quantity").cast("int") - 1) % 10 + 1
        return (
            self.table("lineitem")
            .join(suppliers.where("l_suppkey % 10 = 0"), "l_suppkey", "left")
            .select(
                F.col("l_orderkey").alias("txn"),
                F.col("l_partkey").alias("item"),
                F.col("remote_w"),
                quantity.alias("quantity"),
                "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
            )
        )

    @cached_property
    def plain_lines(self) -> DataFrame:
        """txn, item, quantity: what totals and checks need; no join, no numbering."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("txn"),
            F.col("l_partkey").alias("item"),
            ((F.col("l_quantity").cast("int") - 1) % 10 + 1).alias("quantity"),
        )

    @cached_property
    def request_lines(self) -> DataFrame:
        """Lines numbered from 0 within their order: txn, line, item, remote_w, quantity."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        numbered = running(
            self.bare_lines, ["txn"], order, {"_n": F.lit(1)}, rows=self.rows("lineitem"), sizes=self.order_sizes, ties=True
        )
        return numbered.select(
            "txn", (F.col("_n") - 1).cast("int").alias("line"), "item", "remote_w", "quantity"
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Numbered lines with their order's header: + ts, c, d, w, supply_w."""
        return self.with_header(self.request_lines, self.orders)

    @staticmethod
    def with_header(lines: DataFrame, orders: DataFrame) -> DataFrame:
        """Lines of the given orders, with the default supplier filled in."""
        return (
            lines.join(orders, "txn")
            .withColumn("supply_w", F.coalesce("remote_w", "w"))
            .drop("remote_w")
        )

    # ---- deliveries and payments -----------------------------------------

    @cached_property
    def deliveries(self) -> DataFrame:
        """One delivery request per warehouse and month: txn, ts, w, carrier."""
        month = F.date_trunc("month", F.timestamp_millis("ts"))
        months = self.orders.select("w", month.alias("month")).distinct()
        return months.select(
            (
                F.col("w").cast("long") * 1000000 + F.year("month") * 100 + F.month("month")
            ).alias("txn"),
            F.unix_millis(F.add_months("month", 1).cast("timestamp")).alias("ts"),
            "w",
            (F.month("month") % 10 + 1).cast("int").alias("carrier"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """txn, ts, amount, c or last (three in five go by name), c_d, c_w, d, w."""
        homes = self.table("customer").select(F.col("c_custkey").alias("user_id"), home("c_nationkey").alias("c_w"))
        by_name = F.col("txn") % 5 < 3
        return (
            self.table("events")
            .where("event_type = 'purchase'")
            .select(
                F.col("event_id").alias("txn"),
                ((epoch_ms("ts") - EVENT_BASE_MS) * PAYMENT_STRETCH + PAYMENT_BASE_MS).alias("ts"),
                "user_id",
                F.col("value").cast(MONEY).alias("amount"),
            )
            .join(homes, "user_id")
            .select(
                "txn",
                "ts",
                "amount",
                F.when(~by_name, F.col("user_id")).alias("c"),
                F.when(by_name, last_name(F.col("user_id") % 20)).alias("last"),
                home_district("user_id").alias("c_d"),
                "c_w",
                home_district("user_id").alias("d"),
                F.when(F.col("txn") % 7 == 0, F.col("c_w") % 25 + 1).otherwise(F.col("c_w")).alias("w"),
            )
        )

    # ---- upper bounds on group sizes, cheap to get -----------------------

    def order_sizes(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("txn")).agg(F.count("*").alias("n"))

    def district_sizes(self) -> DataFrame:
        """At most this many orders and polls per district, from per-customer counts.

        A warehouse polls each district once per month it has orders in, which is at most
        the months from its first order to its last.
        """
        homes = self.table("customer").select(F.col("c_custkey").alias("c"), home("c_nationkey").alias("w"))
        per_customer = self.table("orders").groupBy(F.col("o_custkey").alias("c")).agg(
            F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")
        )
        placed = per_customer.join(homes, "c").groupBy("w", home_district("c").alias("d")).agg(
            F.sum("n").alias("placed"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        first, last = (F.date_trunc("month", x) for x in (F.min("first"), F.max("last")))
        span = F.round(F.months_between(last, first)).cast("long") + 1
        months = placed.groupBy("w").agg(F.least(F.sum("placed"), span).alias("months"))
        return placed.join(months, "w").select("w", "d", (F.col("placed") + F.col("months")).alias("n"))

    def item_sizes(self) -> DataFrame:
        """Movements per item over all warehouses (a line moves at most two levels)."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("item"))
            .agg((F.count("*") * 2).alias("n"))
        )
