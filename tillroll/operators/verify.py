"""Accepting requests and sending them to the warehouses that must act on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN_TYPES = ["neworder", "payment", "delivery"]


def rejected(lines: DataFrame, items: DataFrame) -> DataFrame:
    """txn of each order with an unknown item. Only those lines are shuffled."""
    return unknown_items(lines.select("txn", "item"), items).select("txn").distinct()


def approve(orders: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Every order with ``approved``: all its items exist. One without lines passes."""
    bad = rejected(lines, items).withColumn("_bad", F.lit(True))
    return orders.join(bad, "txn", "left").withColumn("approved", F.col("_bad").isNull()).drop("_bad")


def accept(orders: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    return orders.join(rejected(lines, items), "txn", "left_anti")


def line_facts(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Per order, in one shuffle of partial sums: is every item known, line count, cents.

    Sums of whole cents stay in long arithmetic; wide decimals would not.
    """
    priced = items.select("item", (F.col("price") * 100).cast("long").alias("cents"))
    return lines.join(priced, "item", "left").groupBy("txn").agg(
        F.bool_and(F.col("cents").isNotNull()).alias("all_known"),
        F.count("*").alias("n_lines"),
        F.sum(F.col("cents") * F.col("quantity")).alias("cents"),
    )


def approve_with_totals(orders: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """As ``approve``, with ``n_lines`` and ``total``: one pass over the lines for all three."""
    return orders.join(line_facts(lines, items), "txn", "left").select(
        *orders.columns,
        F.coalesce("all_known", F.lit(True)).alias("approved"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        (F.coalesce("cents", F.lit(0)).cast("decimal(20,0)") / 100).cast("decimal(22,2)").alias("total"),
    )


def unknown_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines whose item does not exist."""
    return lines.join(items.select("item"), "item", "left_anti")


def approve_by_type(kind: Column, order_approved: Column) -> Column:
    """Payments and deliveries always pass; types nobody knows never do."""
    return (
        F.when(kind == "neworder", order_approved)
        .when(kind.isin("payment", "delivery"), F.lit(True))
        .otherwise(F.lit(False))
    )


def order_warehouses(accepted_orders: DataFrame, lines: DataFrame) -> DataFrame:
    """(txn, w) once for the home warehouse and each supplying one. ``accepted_orders``: one row per txn.

    The suppliers meet per order, at most one entry for each warehouse, so the lines are shuffled once, by txn.
    """
    array_of_w = T.ArrayType(accepted_orders.schema["w"].dataType)
    remote = lines.where("remote_w is not null").groupBy("txn").agg(F.collect_set("remote_w").alias("_remote"))
    home = F.array("w")
    everywhere = F.when(F.col("_remote").isNull(), home).otherwise(F.array_union(home, F.col("_remote").cast(array_of_w)))
    return (
        accepted_orders.select("txn", "w").join(remote, "txn", "left")
        .select("txn", F.explode(everywhere).alias("w"))
    )


def known_types(log: DataFrame, type_column: str = "type") -> DataFrame:
    """The log as it is; reading a row of a type nobody knows raises."""
    kind = F.col(type_column)
    return log.where(
        F.when(kind.isin(*KNOWN_TYPES), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("unknown transaction type "), F.coalesce(kind, F.lit("null"))))
        )
    )


def route(log: DataFrame, type_column: str = "type") -> dict[str, DataFrame]:
    """One branch per type; a row of any other type raises, whichever branch is read."""
    checked = known_types(log, type_column)
    return {name: checked.where(F.col(type_column) == name) for name in KNOWN_TYPES}


def local_lines(lines: DataFrame) -> DataFrame:
    return lines.where("supply_w = w")


def remote_lines(lines: DataFrame) -> DataFrame:
    return lines.where("supply_w <> w")
