"""Operations on whole logs: duplicates, compaction, state as of a point, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop later records with a key seen before. ``order`` must not tie within a key.

    Partial minima keep hot keys cheap; one per column, so that fixed-width columns
    stay in a hash aggregate.
    """
    rest = [x for x in log.columns if x not in keys]
    first = log.groupBy(*keys).agg(*[F.min_by(x, _rank(order)).alias(x) for x in rest])
    return first.select(*log.columns)


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The last value of each key; a last value of null removes the key."""
    last = log.groupBy(*keys).agg(F.max_by(value, _rank(order)).alias(value))
    return last.where(F.col(value).isNotNull())


def as_of(log: DataFrame, until: Column | int, time: str = "ts") -> DataFrame:
    """The log as it was when ``until`` was the last time written."""
    return log.where(F.col(time) <= until)


def lookup(requested: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """The row of ``table`` for each key asked for, each key once."""
    return requested.select(*on).distinct().join(table, list(on))


def missing_keys(requested: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys asked for that ``table`` does not have."""
    return requested.select(*on).distinct().join(table.select(*on), list(on), "left_anti")


def lookup_strict(requested: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Like ``lookup``, but a key that is not there raises and names it."""
    found = requested.select(*on).distinct().join(table.withColumn("_found", F.lit(True)), list(on), "left")
    name = F.concat_ws(", ", *[F.col(x).cast("string") for x in on])
    return found.where(
        F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row for key "), name)))
    ).drop("_found")


def peek(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records of the chosen transactions."""
    return log.join(chosen.select("txn").distinct(), "txn", "left_semi")
