"""As-of joins: each row meets the newest row of another table at or before its moment.

Both tables go into one log, in order of key and moment, and the newest right row is carried along it: one
shuffle and one sort, no pairs of rows, and a key with any number of rows can be split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.scan import folded, latest


def join_asof(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, strict: bool = False, **bounds
) -> DataFrame:
    """Every row of ``left`` with the columns of the newest ``right`` row of equal ``keys`` at or before its ``at``.

    ``strict``: only right rows before ``at``. Left rows without one keep nulls; a null key or ``at`` meets nothing.
    Of right rows at the same moment the one with the largest columns counts.
    ``at`` may be a struct, compared field by field. The right table's ``at`` is not returned; its other columns
    may not be named as the left one's. ``bounds`` as for ``folded``: rows and sizes of both tables together.
    """
    fields = [c for c in right.columns if c not in (*keys, at)]
    clash = set(fields) & set(left.columns)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")

    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, at)])
    row, found = F.struct(*left.columns), F.struct(*fields)
    no_left = F.lit(None).cast(left.select(row).schema[0].dataType)
    no_right = F.lit(None).cast(right.select(found).schema[0].dataType)
    log = (
        left.where(known).select(*keys, at, row.alias("_left"), no_right.alias("_right"))
        .unionByName(right.where(known).select(*keys, at, no_left.alias("_left"), found.alias("_right")))
        # at the same moment: right rows first, or last if only earlier ones count
        .withColumn("_turn", F.col("_left").isNull() == F.lit(strict))
    )
    carried = folded(log, keys, [at, "_turn", "_right"], {"_found": latest(F.col("_right"))}, ties=True, **bounds)
    met = carried.where(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in fields])
    return met.unionByName(left.where(~known), allowMissingColumns=True)
