"""Running sums and minima per key that also hold up when one key is hot.

A window puts each key's rows into one task. That is the plan to use while
groups are small, and the one Spark runs here for all keys below ``hot_rows``.
Keys above it are range-partitioned on (key, order), so that one key spreads
over as many tasks as it needs; each task's slice is summed by itself, and the
sums of the slices before it are added from a table that has about one row per
slice. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import settle

HOT_ROWS = 4_000_000


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    floors: dict[str, Column] | None = None,
    rows: int | None = None,
    sizes: Callable[[], DataFrame] | None = None,
    hot_rows: int | None = None,
    ties: bool = False,
) -> DataFrame:
    """Add running totals to every row.

    ``sums``: inclusive running sum of each expression, per key in the given order.
    ``floors``: running minimum over the rows *before* this one (null on the first);
    may use the names in ``sums``.
    ``rows``: an upper bound on all of ``df``'s rows, if known; no group can be hot
    when that is small. ``sizes``: gives key columns and ``n``, an upper bound on each
    group's rows that is cheaper to get than counting ``df``; its key columns may be
    fewer than ``keys``. ``ties``: rows may agree on the whole order; a hot group of
    such copies can then still be split.
    """
    floors = floors or {}

    def plain(part, order):
        return _in_one_window(part, keys, order, sums, floors)

    def sliced(part, order, slices):
        return _in_slices(part, keys, order, sums, floors, slices)

    return _dealt(df, keys, order, plain, sliced, rows, sizes, hot_rows, ties)


def _dealt(df, keys, order, plain, sliced, rows, sizes, hot_rows, ties):
    """``plain(part, order)`` for the rows of ordinary keys, ``sliced(part, order, slices)`` for those of hot ones."""
    hot_rows = hot_rows or int(df.sparkSession.conf.get("tillroll.hotRows", str(HOT_ROWS)))
    if rows is not None and rows <= hot_rows:
        return plain(df, order)
    counted = sizes() if sizes else df.groupBy(*keys).agg(F.count("*").alias("n"))
    # the hot keys stay a table; only their number and rows come to the driver
    hot = settle(counted.where(F.col("n") > hot_rows))
    hot_total = hot.agg(F.sum("n")).first()[0]
    if not hot_total:
        return plain(df, order)
    names = [c for c in counted.columns if c != "n"]
    hot_keys = hot.select(*names)
    slices = -(-hot_total // hot_rows) + 1
    # both parts read ``df``: written once, with a number of its own for each of the
    # exact copies, so that the slices can cut between them
    if ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        order = [*order, "_tie"]
    written = settle(df)
    cold = written.join(hot_keys, names, "left_anti")
    warm = written.join(hot_keys, names, "left_semi")
    return plain(cold, order).unionByName(sliced(warm, order, slices)).drop("_tie")


@dataclass(frozen=True)
class Fold:
    """A running value: Spark's aggregate ``of`` over ``value``, and how the values of two stretches of rows, the
    earlier one first, make that of both. ``join`` must be associative; a null is a stretch without a value.

    ``again`` aggregates the values of stretches; it is ``of`` unless that counts or averages.
    """

    value: Column
    of: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    again: Callable[[Column], Column] | None = None

    def total(self, value: Column) -> Column:
        return (self.again or self.of)(value)


def latest(value: Column) -> Fold:
    """The last value that is not null."""
    return Fold(value, lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def highest(value: Column) -> Fold:
    return Fold(value, F.max, F.greatest)


def lowest(value: Column) -> Fold:
    return Fold(value, F.min, F.least)


def number(value: Column) -> Fold:
    """How many values are not null."""
    return Fold(value, F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b, F.sum)


def seen(value: Column) -> Fold:
    """Was any value true?"""
    return Fold(value, F.bool_or, lambda a, b: F.coalesce(a | b, a, b))


def folded(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: dict[str, Fold],
    rows: int | None = None,
    sizes: Callable[[], DataFrame] | None = None,
    hot_rows: int | None = None,
    ties: bool = False,
) -> DataFrame:
    """Add running values of any associative kind, this row included. Bounds as for ``running``."""

    def windowed(part, by, order):
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.withColumns({n: f.of(f.value).over(upto) for n, f in folds.items()})

    def sliced(part, order, slices):
        types = windowed(part, keys, order).schema
        numbered = settle(
            part.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
        )
        at = [*keys, "_slice"]
        inside = windowed(numbered, at, order)
        # a slice's value is its last row's; one row per (key, slice)
        ends = inside.groupBy(*at).agg(F.max_by(F.struct(*folds), F.struct(*order)).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            *[F.col(c).alias(f"_k_{c}") for c in at],
            *[f.total(F.col(f"_end.{n}")).over(earlier).alias(f"_c_{n}") for n, f in folds.items()],
        )
        # null-safe: a null key is a group like any other
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in at])
        out = inside.join(carried, same)
        out = out.withColumns({n: f.join(F.col(f"_c_{n}"), F.col(n)) for n, f in folds.items()})
        return out.select(*[F.col(t.name).cast(t.dataType).alias(t.name) for t in types])

    return _dealt(df, keys, order, lambda part, order: windowed(part, keys, order), sliced, rows, sizes, hot_rows, ties)


def _in_one_window(df, keys, order, sums, floors):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})
    if floors:
        out = out.withColumns({n: F.min(e).over(before) for n, e in floors.items()})
    return out


def _in_slices(df, keys, order, sums, floors, slices):
    plain = _in_one_window(df, keys, order, sums, floors).schema
    sliced = settle(
        df.repartitionByRange(slices, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumns({f"_v_{n}": e for n, e in sums.items()})
    )
    at = [*keys, "_slice"]
    inside = Window.partitionBy(*at).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    # one row per (key, slice). With sizes coarser than the keys these can be many, so
    # whether to broadcast them is left to Spark
    totals = sliced.groupBy(*at).agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    carried = totals.select(*at, *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in sums])
    out = (
        sliced.withColumns({n: F.sum(f"_v_{n}").over(upto) for n in sums})
        .join(carried, at)
        .withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums})
    )
    if floors:
        lows = out.groupBy(*at).agg(*[F.min(e).alias(n) for n, e in floors.items()])
        low = lows.select(*at, *[F.min(n).over(earlier).alias(f"_l_{n}") for n in floors])
        out = out.withColumns({n: F.min(e).over(before) for n, e in floors.items()}).join(
            low, at
        )
        out = out.withColumns({n: F.least(F.col(n), F.col(f"_l_{n}")) for n in floors})
    # plain windows keep the type Spark gives a sum; so does this
    return out.select(*[F.col(f.name).cast(f.dataType) for f in plain])


def recent(
    df: DataFrame,
    keys: Sequence[str],
    rank: str,
    value: Column,
    depth: int,
    name: str,
    block_rows: int = 100_000,
) -> DataFrame:
    """Add an array of the last ``depth`` values up to this row, oldest first.

    ``rank`` numbers each key's rows 1, 2, 3, ...  A long group is cut into blocks
    of ``block_rows``; the last ``depth`` rows of a block are copied in front of the
    next, which is all that its rows can look back to.
    """
    block = F.floor((F.col(rank) - 1) / block_rows)
    in_tail = F.pmod(F.col(rank) - 1, F.lit(block_rows)) >= block_rows - (depth - 1)
    copies = df.withColumn("_own", block).withColumn(
        "_block",
        F.explode(F.when(in_tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(-(depth - 1), 0)
    return (
        copies.withColumn(name, F.collect_list(value).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .drop("_own", "_block")
    )
