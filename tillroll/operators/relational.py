"""The relational form: tables as the SQL back end would leave them.

Spark tables are not updated row by row; each is recomputed from the log, or an
existing table is joined with what changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAREHOUSE_YTD = "300000.00"
DISTRICT_YTD = "30000.00"
CUSTOMER_YTD = "10.00"


def apply_updates(table: DataFrame, updates: DataFrame, on: Sequence[str]) -> DataFrame:
    """``table`` with the columns of ``updates`` replaced where it has a row for the key."""
    changed = [x for x in updates.columns if x not in on]
    marked = updates.select(
        *on, F.lit(True).alias("_hit"), *[F.col(x).alias(f"_new_{x}") for x in changed]
    )
    out = table.join(marked, list(on), "left")
    for x in changed:
        out = out.withColumn(x, F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)))
    return out.select(*table.columns)


def order_table(summaries: DataFrame, delivered: DataFrame) -> DataFrame:
    """Orders with line count, all-local flag and carrier (null while pending)."""
    blank = summaries.withColumn("carrier", F.lit(None).cast("int"))
    return apply_updates(blank, delivered.select("w", "d", "order_id", "carrier"), ["w", "d", "order_id"])


def order_line_table(lines: DataFrame, delivered: DataFrame) -> DataFrame:
    """Order lines numbered from 1, with delivery time (null while pending)."""
    blank = lines.withColumn("number", F.col("line") + 1).drop("line").withColumn(
        "delivered", F.lit(None).cast("long")
    )
    times = delivered.select("w", "d", "order_id", F.col("ts").alias("delivered"))
    return apply_updates(blank, times, ["w", "d", "order_id"])


def stock_table(opening: DataFrame, levels: DataFrame, counters: DataFrame) -> DataFrame:
    """Stock (w, item, quantity) with its quantity and counters after all lines."""
    blank = opening.withColumns({x: F.lit(0).cast("long") for x in ("ytd", "order_count", "remote_count")})
    now = levels.select(F.col("stock_w").alias("w"), "item", F.col("level").alias("quantity"))
    counted = counters.withColumnRenamed("supply_w", "w")
    return apply_updates(apply_updates(blank, now, ["w", "item"]), counted, ["w", "item"])


def customer_table(customers: DataFrame, balances: DataFrame, ytd: DataFrame, texts: DataFrame) -> DataFrame:
    """Customers with balance, payments and deliveries so far, and their text.

    ``texts`` (w, d, c, data) has the newest text of those who have one.
    """
    key = ["w", "d", "c"]
    blank = customers.select(
        *key, "last", "credit", F.col("opening_balance").cast("decimal(22,2)").alias("balance"),
        F.lit(0).cast("decimal(22,2)").alias("paid"),
        F.lit(0).cast("long").alias("payments"), F.lit(0).cast("long").alias("deliveries"),
        F.col("opening_data").alias("data"),
    )
    out = apply_updates(blank, balances, key)
    return apply_updates(apply_updates(out, ytd, key), texts, key)


def district_table(districts: DataFrame, newest: DataFrame, ytd: DataFrame) -> DataFrame:
    """Districts with next order id and amount taken."""
    return (
        districts.join(newest, ["w", "d"], "left")
        .join(ytd, ["w", "d"], "left")
        .select(
            "w", "d", "d_name", "d_tax",
            (F.coalesce("newest", F.lit(0)) + 1).alias("next_id"),
            (F.lit(DISTRICT_YTD).cast("decimal(12,2)") + F.coalesce("ytd", F.lit(0))).cast("decimal(22,2)").alias("ytd"),
        )
    )


def warehouse_table(warehouses: DataFrame, ytd: DataFrame) -> DataFrame:
    return warehouses.join(ytd, "w", "left").select(
        "w", "w_name", "w_tax",
        (F.lit(WAREHOUSE_YTD).cast("decimal(12,2)") + F.coalesce("ytd", F.lit(0))).cast("decimal(22,2)").alias("ytd"),
    )
