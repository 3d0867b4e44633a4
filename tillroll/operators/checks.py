"""Consistency rules. Each returns the rows it looked at with ``ok``; ``violations``
keeps those that break the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import running


def violations(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("ok"))


def next_id(next_ids: DataFrame, pending: DataFrame) -> DataFrame:
    """A district's next order id is one more than its newest pending order's;
    districts with nothing pending are not looked at."""
    newest = pending.groupBy("w", "d").agg(F.max("order_id").alias("newest"))
    return next_ids.join(newest, ["w", "d"]).withColumn("ok", F.col("next_id") - 1 == F.col("newest"))


def contiguous(pending: DataFrame) -> DataFrame:
    """Pending order ids have no gaps."""
    return (
        pending.groupBy("w", "d")
        .agg(F.min("order_id").alias("oldest"), F.max("order_id").alias("newest"), F.count("*").alias("n"))
        .withColumn("ok", F.col("newest") - F.col("oldest") + 1 == F.col("n"))
    )


def carrier(state: DataFrame, pending: DataFrame) -> DataFrame:
    """A customer's newest order has no carrier exactly when it is pending."""
    waiting = pending.select("w", "d", "order_id", F.lit(True).alias("waiting"))
    return (
        state.join(waiting, ["w", "d", "order_id"], "left")
        .withColumn("waiting", F.coalesce("waiting", F.lit(False)))
        .withColumn("ok", F.col("waiting") == F.col("carrier").isNull())
    )


def delivery_date(lines: DataFrame) -> DataFrame:
    """A line has no delivery time exactly when its order has no carrier."""
    return lines.withColumn("ok", F.col("delivered").isNull() == F.col("carrier").isNull())


def payment_delta(balances: DataFrame, payment_kind: int, opening, **bounds) -> DataFrame:
    """A payment lowers the balance by its amount (``balances``: w, d, c, ts, kind, txn, change, balance).

    Rows are numbered per customer and joined to the one before; the number is part
    of the join key, so a busy customer's rows spread out.
    """
    key = ["w", "d", "c"]
    numbered = running(balances, key, ["ts", "kind", "txn"], {"_n": F.lit(1)}, **bounds)
    previous = numbered.select(*key, (F.col("_n") + 1).alias("_n"), F.col("balance").alias("before"))
    return (
        numbered.join(previous, [*key, "_n"], "left")
        .withColumn("before", F.coalesce("before", opening))
        .where(F.col("kind") == payment_kind)
        .withColumn("ok", F.col("balance") - F.col("before") == F.col("change"))
        .drop("_n")
    )
