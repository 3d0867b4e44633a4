"""Finding customers by last name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import running

NAME_KEY = ["w", "d", "last"]


def by_first_name(customers: DataFrame, **bounds) -> DataFrame:
    """Customers of each last name numbered in first-name order (``position`` from 1)."""
    return running(customers, NAME_KEY, ["first", "c"], {"position": F.lit(1)}, **bounds)


def middle_customers(customers: DataFrame, variant: str = "event", **bounds) -> DataFrame:
    """The one customer each (w, d, last) stands for.

    ``event``: position n/2 + 1 rounded down; ``sql``: position (n + 1)/2 rounded
    down. They differ when n is even.
    """
    chosen = {
        "event": F.floor(F.col("n") / 2) + 1,
        "sql": F.floor((F.col("n") + 1) / 2),
    }[variant]
    middle = customers.groupBy(*NAME_KEY).agg(F.count("*").alias("n")).select(
        *NAME_KEY, chosen.alias("position")
    )
    named = by_first_name(customers.select(*NAME_KEY, "first", "c"), **bounds)
    return named.join(middle, [*NAME_KEY, "position"]).select(*NAME_KEY, "c")


def resolve(requests: DataFrame, customers: DataFrame, variant: str = "event", **bounds) -> DataFrame:
    """Fill in ``c`` where a request gives only ``last`` (with c_w, c_d)."""
    middle = middle_customers(customers, variant, **bounds).select(
        F.col("w").alias("c_w"), F.col("d").alias("c_d"), "last", F.col("c").alias("_named")
    )
    return requests.join(middle, ["c_w", "c_d", "last"], "left").withColumn(
        "c", F.coalesce("c", "_named")
    ).drop("_named")
