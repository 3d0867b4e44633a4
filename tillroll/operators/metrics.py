"""Duration statistics from the metrics records ``t, event, duration``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import running


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], **bounds) -> DataFrame:
    """Exact percentiles (linear between neighbours) per key.

    Equal values are counted first; a running total over the distinct values then
    finds each position, so no group has to be held in one place.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    reached = running(counted, keys, [value], {"_upto": F.col("_n")}, **bounds)
    totals = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    placed = reached.join(totals, list(keys))
    found = []
    for name, fraction in fractions.items():
        at = (F.col("_total") - 1) * F.lit(fraction)
        found += [
            F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
        ]
    out = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *found)
    for name, fraction in fractions.items():
        at = (F.col("_total") - 1) * F.lit(fraction)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, low + (high - low) * (at - F.floor(at)))
    return out.select(*keys, *fractions)


def duration_stats(durations: DataFrame, width: str = "1 hour", limit: float | None = None, **bounds) -> DataFrame:
    """Count, mean, median, 95th percentile per event type and time window, and how
    many took longer than ``limit``. ``durations``: t, event, duration (decimal)."""
    timed = durations.withColumn("start", F.unix_millis(F.window("t", width).start)).drop("t")
    keys = ["event", "start"]
    over = F.count_if(F.col("duration") > limit) if limit is not None else F.lit(0)
    plain = timed.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.sum("duration").cast("double") / F.count("*")).alias("mean"),
        over.cast("long").alias("over_limit"),
    )
    as_double = timed.withColumn("duration", F.col("duration").cast("double"))
    return plain.join(percentiles(as_double, keys, "duration", {"p50": 0.5, "p95": 0.95}, **bounds), keys)
