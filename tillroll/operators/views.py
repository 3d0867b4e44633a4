"""Read views: order status and the customer state behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.orders import latest_per_customer
from tillroll.sources.shop import OPENING_BALANCE


def customer_state(numbered: DataFrame, done: DataFrame, balances: DataFrame) -> DataFrame:
    """Per customer who has ordered: balance, newest order, its carrier and delivery time.

    The carrier shows only once that newest order itself has been delivered.
    """
    latest = latest_per_customer(numbered.select("w", "d", "c", "order_id", "ts", "txn"))
    shipped = done.select("w", "d", "order_id", "carrier", F.col("ts").alias("delivered"))
    return (
        latest.join(shipped, ["w", "d", "order_id"], "left")
        .join(balances.select("w", "d", "c", "balance"), ["w", "d", "c"], "left")
        .withColumn("balance", F.coalesce("balance", F.lit(OPENING_BALANCE).cast("decimal(22,2)")))
    )


def order_status(state: DataFrame, customers: DataFrame) -> DataFrame:
    return state.join(customers.select("w", "d", "c", "first", "middle", "last"), ["w", "d", "c"])


def order_status_lines(state: DataFrame, lines: DataFrame) -> DataFrame:
    """The newest order's lines with their delivery time, null until delivered."""
    return state.select("w", "d", "c", "order_id", "txn", "delivered").join(
        lines.select("txn", "line", "item", "supply_w", "quantity", "amount"), "txn"
    )


def payment_key(payments: DataFrame, compat: bool = False) -> DataFrame:
    """Payments under the key the view applies them to: the customer's own district,
    or with ``compat`` the paying one."""
    if compat:
        return payments.withColumns({"c_w": F.col("w"), "c_d": F.col("d")})
    return payments
