"""Stock levels.

A line takes its quantity from the supplier's level; if that leaves less than 10,
91 are added. Levels therefore stay in 10..100, which is 91 values, and the level
after any number of lines is the running sum of quantities, modulo 91.

A line of more than 81 may leave less than 10 even after its restocking, and the next line is then
restocked whatever it takes. With need(n) the restockings that would bring the sum of n lines to 10 or more, the number
made after n lines is the smaller of need(n) and one more than before, which is n plus the least of 0 and
need(j) - j over all j up to n: a running minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import running
from tillroll.sources.shop import initial_stock

# Lowest level kept, and what one restocking adds.
LOWEST = 10
RESTOCK = 91
# above this, one restocking might not reach LOWEST again
MOST_PER_LINE = RESTOCK - LOWEST


def level_after(start: Column, taken: Column) -> Column:
    """Level once ``taken`` in all has been taken from ``start``."""
    left = start - taken
    wrapped = F.pmod(left - LOWEST, F.lit(RESTOCK)) + LOWEST
    return F.when((left >= LOWEST) | (taken == 0), left).otherwise(wrapped)


def restocks_needed(start, taken):
    """Restockings after which a level ``start`` less ``taken`` would be LOWEST or more."""
    return F.greatest(F.lit(0), F.ceil((taken - start + LOWEST) / RESTOCK))


def checked(quantity: Column, any_quantity: bool = False) -> Column:
    fits = quantity >= 0 if any_quantity else quantity.between(0, MOST_PER_LINE)
    return F.when(fits, quantity).otherwise(
        F.raise_error(F.concat(F.lit("quantity out of range: "), quantity.cast("string")))
    )


def movements(lines: DataFrame, any_quantity: bool = False) -> DataFrame:
    """What each line reads or takes, one row per warehouse it concerns.

    Quantities from 0 to 81; with ``any_quantity`` also larger ones. Others raise.

    A line from another warehouse takes stock there and only looks at the level at
    home: a movement of zero. ``lines``: txn, ts, line, item, w, supply_w, quantity.
    """
    # constant arrays of numbers: arrays of rows would be made anew for each line
    home, supply, look = (F.lit(n) for n in range(3))
    rows = F.when(F.col("supply_w") != F.col("w"), F.array(supply, look)).otherwise(F.array(home))
    role = F.col("_m")
    return lines.withColumn("_m", F.explode(rows)).select(
        "*",
        F.when(role == supply, "supply").when(role == look, "look").otherwise("home").alias("role"),
        F.when(role == supply, F.col("supply_w")).otherwise(F.col("w")).alias("stock_w"),
        F.when(role == look, 0).otherwise(checked(F.col("quantity"), any_quantity)).alias("taken"),
    ).drop("_m")


def with_levels(
    moved: DataFrame, start: DataFrame | None = None, any_quantity: bool = False, **bounds
) -> DataFrame:
    """Add ``level``, the stock after each movement in log order.

    ``start`` (stock_w, item, start_level) replaces the default opening level; ``any_quantity``: lines may
    take more than 81; ``bounds`` as for ``running``.
    """
    opening = initial_stock(F.col("item"))
    if start is not None:
        moved = moved.join(start, ["stock_w", "item"], "left")
        opening = F.coalesce("start_level", opening)
    sums, floors = {"_total": F.col("taken")}, {}
    over = restocks_needed(F.col("_opening"), F.col("_total")) - F.col("_served")
    if any_quantity:
        sums["_served"] = (F.col("role") != "look").cast("int")
        floors["_low"] = over
    out = running(
        moved.withColumn("_opening", opening), ["stock_w", "item"], ["ts", "txn", "line"], sums, floors, **bounds
    )
    if any_quantity:
        restocked = F.col("_served") + F.least(F.lit(0), F.col("_low"), over)
        level = (F.col("_opening") - F.col("_total") + restocked * RESTOCK).cast("bigint")
    else:
        level = level_after(F.col("_opening"), F.col("_total"))
    return out.withColumn("level", level).drop("_opening", "_total", "_served", "_low", "start_level")


def current_levels(
    moved: DataFrame, start: DataFrame | None = None, any_quantity: bool = False, **bounds
) -> DataFrame:
    """Final level per (stock_w, item) touched: a plain sum, order does not matter. With ``any_quantity``
    it does, and the last level in log order is taken."""
    if any_quantity:
        last = F.max_by("level", F.struct("ts", "txn", "line")).alias("level")
        return with_levels(moved, start, True, **bounds).groupBy("stock_w", "item").agg(last)
    total = moved.groupBy("stock_w", "item").agg(F.sum("taken").alias("taken"))
    opening = initial_stock(F.col("item"))
    if start is not None:
        total = total.join(start, ["stock_w", "item"], "left")
        opening = F.coalesce("start_level", opening)
    return total.select("stock_w", "item", level_after(opening, F.col("taken")).alias("level"))


def counters(lines: DataFrame) -> DataFrame:
    """Per (supplier, item): quantity taken, lines served, lines served for other warehouses."""
    return lines.groupBy("supply_w", "item").agg(
        F.sum("quantity").alias("ytd"),
        F.count("*").alias("order_count"),
        F.count_if(F.col("supply_w") != F.col("w")).alias("remote_count"),
    )


def low_stock(recent_lines: DataFrame, levels: DataFrame, thresholds: DataFrame, distinct: bool = True) -> DataFrame:
    """Items below the threshold among recent lines, for every district in ``thresholds``.

    ``distinct=False`` counts rows, as the SQL form of the query does.
    """
    lines = recent_lines.select("w", "d", "item")
    if distinct:
        lines = lines.distinct()
    at_home = levels.select(F.col("stock_w").alias("w"), "item", "level")
    low = (
        lines.join(at_home, ["w", "item"])
        .join(thresholds, ["w", "d"])
        .where(F.col("level") < F.col("threshold"))
        .groupBy("w", "d")
        .agg(F.count("*").alias("low"))
    )
    return thresholds.join(low, ["w", "d"], "left").select(
        "w", "d", "threshold", F.coalesce("low", F.lit(0)).alias("low")
    )
