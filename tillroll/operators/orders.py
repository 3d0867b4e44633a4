"""Order numbers, order lines and order totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import district_info
from tillroll.operators.scan import running

LOG_ORDER = ["ts", "txn"]


def number_orders(orders: DataFrame, start: DataFrame | None = None, **bounds) -> DataFrame:
    """Add ``order_id``: 1, 2, 3, ... per district in log order.

    ``start`` (w, d, next_id) continues earlier numbering; ``bounds`` as for ``running``.
    """
    out = running(orders, ["w", "d"], LOG_ORDER, {"order_id": F.lit(1)}, **bounds)
    if start is not None:
        out = out.join(start.select("w", "d", "next_id"), ["w", "d"], "left").withColumn(
            "order_id", F.col("order_id") + F.coalesce("next_id", F.lit(1)) - 1
        ).drop("next_id")
    return out


def priced_lines(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with their item's name and price, and the amount: 18 digits, which Spark
    keeps in a long."""
    amount = F.col("price") * F.col("quantity").cast("decimal(5,0)")
    return lines.join(items, "item").withColumn("amount", amount)


def with_dist_info(lines: DataFrame, stock: DataFrame, dist: Column) -> DataFrame:
    """Add the supplier's text for the home district. ``stock``: w, item and what ``dist``, the array of
    ten texts, is made from. Lines without a stock row are an error."""
    rows = stock.withColumnRenamed("w", "supply_w").withColumn("_found", F.lit(True))
    text = F.when(F.col("_found"), district_info(dist, F.col("d"))).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("no stock row for"), F.col("supply_w"), F.col("item")))
    )
    return lines.join(rows, ["supply_w", "item"], "left").select(*lines.columns, text.alias("dist_info"))


def summary(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per order: amount (0 without lines), line count, whether all lines are local."""
    per_order = lines.groupBy("txn").agg(
        F.sum("amount").alias("amount"),
        F.count("*").alias("n_lines"),
        F.bool_and(F.col("supply_w") == F.col("w")).alias("all_local"),
    )
    return orders.join(per_order, "txn", "left").select(
        *orders.columns,
        F.coalesce("amount", F.lit(0)).cast("decimal(22,2)").alias("amount"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("all_local", F.lit(True)).alias("all_local"),
    )


def newest_ids(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("w", "d").agg(F.max("order_id").alias("newest"))


def recent_orders(numbered: DataFrame, depth: int = 20, newest: DataFrame | None = None) -> DataFrame:
    """The newest ``depth`` orders of each district. Ids have no gaps, so this is a filter."""
    newest = newest_ids(numbered) if newest is None else newest
    return (
        numbered.join(newest, ["w", "d"]).where(F.col("order_id") > F.col("newest") - depth).drop("newest")
    )


def latest_per_customer(numbered: DataFrame) -> DataFrame:
    """Each customer's newest order: w, d, c, then the order's other columns."""
    rest = [x for x in numbered.columns if x not in ("w", "d", "c")]
    return numbered.groupBy("w", "d", "c").agg(*[F.max_by(x, "order_id").alias(x) for x in rest])
