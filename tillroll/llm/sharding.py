"""Shards of near equal bytes by best-fit-decreasing packing of indivisible groups.

Packing is done in two levels, so that no task and not the driver sees all groups. First, groups are
dealt by hash to tasks, and each task packs its own, largest first, each into the box with the
tightest remaining room that holds it. Boxes hold a fixed share of all bytes, so there are a bounded number of
them, however many groups there are; a group larger than a box is a box of its own. Then the boxes are
packed the same way into the shards: a box beyond a shard's even share of what is left alone, the others with the
smallest capacity that the method finds.

Remaining rooms are kept in a balanced search tree (a treap), so a fit takes logarithmic time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import settle

#: Boxes of the first level for each shard.
BOXES = 512
#: Row numbers are given within this many buckets of each shard.
BUCKETS = 1024


class Rooms:
    """Remaining rooms of bins, (room, bin), in a treap: ordered by room, heap-ordered by a hash."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key: tuple[int, int]) -> int:
        return hash((key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xBF58476D1CE4E5B9) & (1 << 61) - 1) * 0x94D049BB133111EB % (1 << 61)

    @classmethod
    def _split(cls, node, key):
        """Nodes with smaller keys, and the others."""
        if node is None:
            return None, None
        own, rank, left, right = node
        if own < key:
            low, high = cls._split(right, key)
            return (own, rank, left, low), high
        low, high = cls._split(left, key)
        return low, (own, rank, high, right)

    @classmethod
    def _join(cls, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return low[0], low[1], low[2], cls._join(low[3], high)
        return high[0], high[1], cls._join(low, high[2]), high[3]

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, (key, self._rank(key), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest room of at least ``size``, the lowest bin among equals."""
        low, high = self._split(self.root, (size, -1))
        node = high
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            return None
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._join(low, rest)
        return key


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """A bin for each of the sizes, given in descending order; a size beyond the capacity is alone."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        key = rooms.take(size)
        if key is None:
            key = (capacity, bins)
            bins += 1
        out.append(key[1])
        if key[0] > size:
            rooms.add((key[0] - size, key[1]))
    return out


def fewest(sizes: list[int], shards: int) -> tuple[list[int], int]:
    """Bins for the sizes, given in descending order, no more than ``shards`` of them; and the capacity of the
    shared ones. A size beyond the mean load of the bins left is alone in one. For the others it is the
    smallest capacity, to about a ten-thousandth of the mean load, with which best fit needs no more bins
    than are left."""
    alone, total = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, left = sizes[alone:], shards - alone
    low = max([math.ceil(total / left), *rest[:1], 1])
    step = max(1, total // left // 10_000)
    capacity = low
    while max(bins := best_fit(rest, capacity), default=0) >= left:
        capacity += step
        step += step // 4 + 1
    return [*range(alone), *(alone + b for b in bins)], capacity


def _boxes(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best fit over rows that arrive by descending size."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        rooms, bins = Rooms(), 0
        for batch in batches:
            out = []
            for size in batch.column("size").to_pylist():
                key = rooms.take(size)
                if key is None:
                    key = (capacity, bins)
                    bins += 1
                out.append(task + key[1])
                if key[0] > size:
                    rooms.add((key[0] - size, key[1]))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "size": batch.column("size"), "box": pa.array(out, pa.int64())})

    return run


def pack(groups: DataFrame, shards: int, boxes: int = BOXES) -> DataFrame:
    """(key, shard) for ``groups`` (key, size bigint): into ``shards`` shards of near equal size.

    Every group is in one shard whole. A group larger than the mean load of the shards left has a shard for
    itself; the others differ by about one part in ``boxes``. No groups: no rows.
    """
    spark = groups.sparkSession
    stats = groups.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total, n = stats["total"] or 0, stats["n"]
    capacity = max(1, total // (shards * boxes))
    # tasks enough for the rows, few enough for a task to fill its boxes
    tasks = int(max(1, min(n // 20_000 + 1, shards * boxes // 16)))
    kind = groups.schema["key"].dataType.simpleString()
    dealt = groups.select("key", F.col("size").cast("bigint").alias("size")).repartition(tasks, "key")
    boxed = settle(
        dealt.sortWithinPartitions(F.desc("size"), "key")
        .mapInArrow(_boxes(capacity), f"key {kind}, size bigint, box bigint")
    )
    # at most one box in each task is under half full, so there are fewer than 2 * total / capacity + tasks
    rows = boxed.groupBy("box").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "box").collect()
    placed, _ = fewest([r["size"] for r in rows], shards)
    where = spark.createDataFrame([(r["box"], s) for r, s in zip(rows, placed)], "box bigint, shard int")
    return boxed.join(F.broadcast(where), "box").select("key", "shard")


def _measured(docs: DataFrame, *carried: Column) -> DataFrame:
    return docs.select(
        *carried,
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("none")).alias("_key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_bucket"),
    )


def _numbered(rows: DataFrame, shards: int, boxes: int) -> DataFrame:
    keys = settle(rows.select("_key", "size", "_bucket"))
    groups = keys.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size"))
    placed = settle(pack(groups, shards, boxes).withColumnRenamed("key", "_key"))
    # row numbers: within buckets, behind the buckets before
    counts = keys.join(placed, "_key").groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size", "_key")
    # offsets: one row for each shard and bucket, whatever the input
    return (
        rows.join(placed, "_key")
        .withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_key", "_bucket", "_at", "_before")
    )


ADDED = ("size", "text_crc32", "shard", "slot")


def shard(docs: DataFrame, shards: int = 16, boxes: int = BOXES) -> DataFrame:
    """Returns ``docs`` (doc_id, text, others) with size, text_crc32, shard and slot added.

    Size: UTF-8 bytes of the text (null: none) plus 1. Rows of equal text are a group and go to one shard;
    null texts are one group, as are empty ones. text_crc32 is unsigned, 0 for null. Slots number each
    shard's rows from 0 without gaps, by hash of doc_id, then doc_id and text, so reruns agree;
    equal rows are interchangeable. Columns with the added names are replaced.
    """
    # the row travels as one column, so that none of its names can clash
    given = F.struct(*[F.col(c) for c in docs.columns if c not in ADDED]).alias("row")
    return _numbered(_measured(docs, given), shards, boxes).select("row.*", *ADDED)


def shard_rows(docs: DataFrame, shards: int = 16, boxes: int = BOXES) -> DataFrame:
    """The shards without the texts: (doc_id, size, text_crc32, law, shard, slot, grown_shard). The law is
    ``bytes``: sizes near equal; nothing is said of one shard more, so grown_shard is null."""
    rows = settle(_measured(docs))
    return _numbered(rows, shards, boxes).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
