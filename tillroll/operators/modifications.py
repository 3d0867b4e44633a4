"""The modification log: what the workers tell the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Modification id of a new order and of a payment. A delivery uses its
# district, a remote stock change its line number.
NEW_ORDER_ID = 20
PAYMENT_ID = 0


def stock_modifications(lines: DataFrame, moved: DataFrame) -> DataFrame:
    """The log's rows that tell of stock; arguments as for ``modification_log``."""
    bought = lines.select(
        F.lit("neworder-line").alias("type"), "txn", F.lit(NEW_ORDER_ID).alias("modification_id"), "ts",
        "w", "d", "line", "item", "supply_w", "quantity", F.col("amount").cast("decimal(22,2)").alias("amount"),
        "dist_info", F.col("level").alias("stock_level"),
    )
    remote = moved.where("role = 'supply'").select(
        F.lit("remote-stock").alias("type"), "txn", F.col("line").alias("modification_id"), "ts",
        F.col("stock_w").alias("w"), "item", F.col("level").alias("stock_level"),
    )
    return bought.unionByName(remote, allowMissingColumns=True)


def order_modifications(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        F.lit("neworder").alias("type"), "txn", F.lit(NEW_ORDER_ID).alias("modification_id"), "ts",
        "w", "d", "c", "order_id", F.col("total").cast("decimal(22,2)").alias("amount"),
    )


def payment_modifications(paid: DataFrame) -> DataFrame:
    """``paid``: payments with the balance and the customer's text (customer_data) after them."""
    return paid.select(
        F.lit("payment").alias("type"), "txn", F.lit(PAYMENT_ID).alias("modification_id"), "ts",
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c",
        F.col("amount").cast("decimal(22,2)").alias("amount"), "balance", "customer_data",
    )


def delivery_modifications(delivered: DataFrame) -> DataFrame:
    return delivered.select(
        F.lit("delivery").alias("type"), "txn", F.col("d").alias("modification_id"), "ts",
        "w", "d", "c", "order_id", "carrier", F.col("total").cast("decimal(22,2)").alias("amount"),
    )


def modification_log(
    numbered: DataFrame, lines: DataFrame, moved: DataFrame, balances: DataFrame, payments: DataFrame,
    texts: DataFrame, delivered: DataFrame, customers: DataFrame,
) -> DataFrame:
    """All modifications in one table, keyed (txn, modification_id, type, line).

    New orders and their lines stay apart, so an order of any size is many short rows.
    ``lines`` have amount, dist_info and the home warehouse's level; ``moved`` the suppliers' levels;
    ``texts`` (txn, data) the text after each payment of a bad-credit customer. Others keep the text
    they opened with (``customers``: w, d, c, opening_data).
    """
    # texts are far larger than Spark takes them to be: never broadcast
    opening = customers.select(F.col("w").alias("c_w"), F.col("d").alias("c_d"), "c", "opening_data").hint("merge")
    paid = payments.join(balances.select("txn", "kind", "balance").where("kind = 2").drop("kind"), "txn").join(
        texts.select("txn", "data"), "txn", "left"
    ).join(opening, ["c_w", "c_d", "c"], "left").withColumn("customer_data", F.coalesce("data", "opening_data"))
    out = order_modifications(numbered)
    for part in (stock_modifications(lines, moved), payment_modifications(paid), delivery_modifications(delivered)):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def stock_writes(log: DataFrame) -> DataFrame:
    """Levels the view is told, from the modification log: home levels with new orders' lines, supplier
    levels otherwise (their modification id is the line)."""
    line = F.coalesce("line", "modification_id")
    return log.where("type in ('neworder-line', 'remote-stock')").select(
        F.col("w").alias("stock_w"), "item", "ts", "txn", line.alias("line"), F.col("stock_level").alias("level")
    )


def view_stock(writes: DataFrame) -> DataFrame:
    """The last level written per (warehouse, item)."""
    return writes.groupBy("stock_w", "item").agg(
        F.max_by("level", F.struct("ts", "txn", "line")).alias("level")
    )
