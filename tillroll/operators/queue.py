"""Matching deliveries to the oldest pending order of each district.

A delivery polls ten queues, one per district, and an empty queue gives nothing.
With A orders and n polls so far, the polls that found the queue empty number
max(0, max over polls so far of n - A): whatever the running minimum of A - n
falls below zero. So poll n pops order number n - (empty polls), and no queue
has to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import running
from tillroll.sources.shop import DELIVERY, DISTRICTS, NEW_ORDER


def polls(deliveries: DataFrame) -> DataFrame:
    """One poll per delivery and district, also where there are fewer than ten."""
    return deliveries.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(DISTRICTS))))


def district_log(
    orders: DataFrame,
    deliveries: DataFrame,
    start: DataFrame | None = None,
    **bounds,
) -> DataFrame:
    """Accepted orders (kind 0) and polls (kind 1) of each district with ``order_id``.

    An order's id is its number in the district; a poll's is the order it pops,
    null if the queue is empty. ``orders``: txn, ts, w, d, c, total. ``start``
    (w, d, next_id, pending) holds the queues left by an earlier run (see ``queues``; their orders go
    to ``delivered``); ``bounds`` as for ``running``.
    """
    log = (
        orders.select("w", "d", "ts", F.lit(NEW_ORDER).alias("kind"), "txn", "c", "total", F.lit(None).cast("int").alias("carrier"))
        .unionByName(
            polls(deliveries).select("w", "d", "ts", F.lit(DELIVERY).alias("kind"), "txn", "carrier"),
            allowMissingColumns=True,
        )
    )
    if start is None:
        log = log.withColumns({"next_id": F.lit(1), "pending": F.lit(0)})
    else:
        log = log.join(start.select("w", "d", "next_id", "pending"), ["w", "d"], "left").fillna(
            {"next_id": 1, "pending": 0}
        )
    is_order = F.col("kind") == NEW_ORDER
    out = running(
        log,
        ["w", "d"],
        ["ts", "kind", "txn"],
        sums={"arrived": is_order.cast("int"), "polled": (~is_order).cast("int")},
        floors={"lowest": F.col("pending") + F.col("arrived") - F.col("polled")},
        **bounds,
    )
    spare = F.col("pending") + F.col("arrived") - F.col("polled")
    lowest = F.least(F.coalesce("lowest", F.lit(0)), F.lit(0))
    oldest_before = F.col("next_id") - F.col("pending") - 1
    popped = F.when(spare >= lowest, oldest_before + F.col("polled") + lowest)
    return out.withColumn(
        "order_id", F.when(is_order, F.col("next_id") - 1 + F.col("arrived")).otherwise(popped)
    ).drop("arrived", "polled", "lowest", "next_id", "pending")


def numbered_orders(log: DataFrame) -> DataFrame:
    return log.where(F.col("kind") == NEW_ORDER).drop("kind", "carrier")


def delivered(log: DataFrame, orders: DataFrame | None = None, waiting: DataFrame | None = None) -> DataFrame:
    """One row per delivered order: w, d, order_id, txn, ts, carrier, c, total.

    ``waiting`` (w, d, order_id, c, total): the orders that were pending at the log's ``start``; polls take
    those first, so without them their deliveries cannot be completed. (w, d, order_id) is unique on both sides, so the join spreads evenly.
    """
    hits = log.where((F.col("kind") == DELIVERY) & F.col("order_id").isNotNull())
    orders = numbered_orders(log) if orders is None else orders
    placed = orders.select("w", "d", "order_id", "c", "total")
    if waiting is not None:
        placed = placed.unionByName(waiting.select("w", "d", "order_id", "c", "total"))
    return hits.select("w", "d", "order_id", "txn", "ts", "carrier").join(placed, ["w", "d", "order_id"])


def queues(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The state a log leaves in each district, as ``district_log`` takes it: w, d, next_id, pending."""
    placed = F.count(F.when(F.col("kind") == NEW_ORDER, True))
    popped = F.count(F.when((F.col("kind") == DELIVERY) & F.col("order_id").isNotNull(), True))
    moved = log.groupBy("w", "d").agg(placed.alias("placed"), popped.alias("popped"))
    if start is None:
        return moved.select("w", "d", (F.col("placed") + 1).alias("next_id"), (F.col("placed") - F.col("popped")).alias("pending"))
    both = moved.join(start.select("w", "d", "next_id", "pending"), ["w", "d"], "full").fillna(
        {"placed": 0, "popped": 0, "next_id": 1, "pending": 0}
    )
    return both.select(
        "w", "d", (F.col("next_id") + F.col("placed")).alias("next_id"),
        (F.col("pending") + F.col("placed") - F.col("popped")).alias("pending"),
    )


def pending(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Orders no delivery has popped."""
    return orders.join(deliveries.select("w", "d", "order_id"), ["w", "d", "order_id"], "left_anti")


def oldest_pending(pending_orders: DataFrame) -> DataFrame:
    rest = [x for x in pending_orders.columns if x not in ("w", "d")]
    return pending_orders.groupBy("w", "d").agg(*[F.min_by(x, "order_id").alias(x) for x in rest])


def delivery_results(deliveries: DataFrame, done: DataFrame) -> DataFrame:
    """Each delivery with its district -> order id map (at most ten entries)."""
    entries = done.groupBy("txn").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "order_id")))).alias("orders")
    )
    empty = F.create_map().cast("map<int,bigint>")
    return deliveries.join(entries, "txn", "left").withColumn(
        "orders", F.coalesce(F.col("orders").cast("map<int,bigint>"), empty)
    )
