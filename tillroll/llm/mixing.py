"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots that hold BLOCK words each. Slot k belongs to the source on whose stretch of the
cumulative targets the golden-ratio point frac(k / golden ratio) falls; such points fill every stretch
evenly from the start, so any run of slots has the sources near their shares. A source's slots are
ranked, and the slot of rank r takes the r-th block of its documents in shuffled order, starting again
after the last. So the points a source gets make up its quota but for a few blocks: what is missing to its
target in whole words comes in slots of its own behind the others, points beyond it stay empty, and
a source too small for a point gets its words too. Slots grow with the words. Blocks cut documents where
they must.

All of it is DataFrame operations. Running totals within a source are taken in buckets of the shuffled
order, so that a large source is spread over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import settle

#: Words in a slot, at every size but the smallest: a mix has SLOTS of them at least, if it has the words.
BLOCK = 1 << 10
SLOTS = 1 << 12
#: The golden ratio's inverse times 2^32, rounded to an odd number.
GOLDEN = 2654435769
POINTS = 1 << 32
WEIGHTS = (5, 2, 1)
#: No more than so many times its words are taken from a source.
REPEATS = 3
#: Buckets of each source's shuffled order, as digits of its md5 key.
BUCKET_DIGITS = 3
#: Cells by which points find their stretch.
CELLS = 1 << 12
CHUNK = 1 << 12


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, total, weight, upto, quota) for ``sizes`` (source, source_size), one row per source.

    The sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target
    stops at REPEATS times its source's size; what is over goes to the others by weight. With the sources in
    order of the level (size by weight) at which they stop, the common level follows from running sums.
    ``upto`` is the sum of the targets so far, ``quota`` the target in whole words: what the rounded sum
    grows by, so that quotas share the sum of all sizes too. Sources are few: one row each in one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEATS)
    stops = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        (F.sum("cap").over(stops.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("full"),
        F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    # the level if this source and all that stop later are the open ones
    level = (F.col("total") - F.col("full")) / F.col("open")
    s = s.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    s = s.withColumn("level", F.max("level").over(Window.partitionBy()))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    s = s.select("source", "source_size", "target", "total", "weight", "cap", upto.alias("upto"))
    whole = F.round("upto").cast("bigint")
    quota = F.greatest(F.lit(0), F.least(F.col("cap"), whole - F.coalesce(F.lag(whole).over(by_name), F.lit(0))))
    return s.withColumn("quota", quota).drop("cap")


def stretches(goals: DataFrame) -> DataFrame:
    """(source, low, high, quota): each source's stretch of the points 0 to 2^32, from ``targets``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = F.max("upto").over(Window.partitionBy())
    s = goals.withColumn("high", F.when(whole > 0, F.floor(F.col("upto") / whole * POINTS)).otherwise(F.lit(0)))
    s = s.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0)))
    return s.select("source", "low", "high", "quota")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2^32, in two halves, so that no product passes 64 bits."""
    slot, half = F.pmod(slot, F.lit(POINTS)), 1 << 16
    high = F.pmod(F.floor(slot / half) * GOLDEN, F.lit(POINTS)) * half
    return F.pmod(high + F.pmod(slot, F.lit(half)) * GOLDEN, F.lit(POINTS))


def slots_for(total: int, block: int) -> int:
    return -(-total // block)


def schedule(goals: DataFrame, block: int, slots: int, point: Callable[[Column], Column] = golden_point) -> DataFrame:
    """(slot, source, rank): which source each slot takes its block of ``block`` words from, and the rank of
    the slot among the source's own, from 0. ``slots`` are drawn by ``point``, a number below 2^32 for each; slots that a
    source's quota has no words for are left out, and what the quota needs beyond them follows, source by source."""
    width = POINTS // CELLS
    cells = stretches(goals).where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    drawn = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") / width)).join(cells, "cell")
    drawn = settle(drawn.where("point >= low and point < high").select("slot", "source"))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    before = _before(drawn, ["source"], "chunk", F.count("*"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = drawn.withColumn("at", F.row_number().over(inside) - 1).join(
        before, drawn["source"].eqNullSafe(before["_source"]) & (drawn["chunk"] == before["_chunk"])
    )
    ranked = ranked.select("slot", "source", (F.col("at") + F.col("before")).alias("rank"))

    # the remainder: as many blocks as points and shares differ by, so few for each source
    points = drawn.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("points"))
    need = F.ceil(F.col("quota") / block)
    short = settle(
        goals.join(points, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", F.coalesce("points", F.lit(0)).alias("points"), need.alias("need"))
    )
    extra = F.greatest(F.lit(0), F.col("need") - F.col("points"))
    behind = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    added = (
        short.withColumn("from", F.coalesce(F.sum(extra).over(behind), F.lit(0)) + slots)
        .where("need > points").withColumn("rank", F.explode(F.expr("sequence(points, need - 1)")))
        .select((F.col("from") + F.col("rank") - F.col("points")).alias("slot"), "source", "rank")
    )
    full = short.select(F.col("source").alias("_source"), "need")
    used = ranked.join(full, F.col("source").eqNullSafe(F.col("_source"))).where("rank < need").select("slot", "source", "rank")
    return used.unionAll(added)


def _before(df: DataFrame, keys: list[str], bucket: str, total: Column) -> DataFrame:
    """Per key and bucket the total of the buckets before it; columns with an underscore in front."""
    sums = df.groupBy(*keys, bucket).agg(total.alias("t"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, bucket]], F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before")
    )


def _mark() -> Column:
    """Tells rows of one id apart by source and text."""
    return F.xxhash64("text", F.col("text").isNull(), "source", F.col("source").isNull())


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark, order (the shuffled order), bucket (its first digits)."""
    order = F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(
        "doc_id", "source", words_in("text").alias("size"), _mark().alias("mark"), order.alias("order"),
        F.substring(order, 1, BUCKET_DIGITS).alias("bucket"),
    )


def _mixed(docs: DataFrame, weights: tuple[int, ...], block: int, point: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, mark, size, source_size, target, taken, slots): ``slots`` has, for each time the source's words are gone
    through, the first slot with words of the row, null if there is none."""
    rows = settle(_measured(docs))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = settle(targets(sizes, weights))
    # one number; the table has a row for each source
    total = goals.agg(F.max("total")).first()[0] or 0
    block = max(1, min(block, total // SLOTS))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # where each document starts in its source's shuffled words
    before = _before(rows, ["source"], "bucket", F.sum("size"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "mark")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("at", F.sum("size").over(upto) - F.col("size"))
        .join(before, same("source", "_source") & (F.col("bucket") == F.col("_bucket")))
        .withColumn("at", F.col("at") + F.col("before"))
        .select("doc_id", "mark", "source", "size", "at")
    )
    goal = goals.select(F.col("source").alias("_source"), "source_size", "target", "quota")
    # written, so that its size is known and the join with the documents is not dealt by source
    placed = settle(placed.join(settle(goal), same("source", "_source")).drop("_source"))
    ranked = schedule(goals, block, slots_for(total, block), point)
    ranked = settle(ranked.select("slot", F.col("source").alias("_source"), F.col("rank").alias("_rank")))

    # the source's words, round after round, end at its quota; block r starts at r * block
    parts = (
        placed.where("size > 0 and quota > 0")
        .withColumn("round", F.explode(F.expr("sequence(0L, (quota - 1) div source_size)")))
        .withColumn("start", F.col("round") * F.col("source_size") + F.col("at"))
        .withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("quota")))
        .where("start < stop")
        .withColumn("rank", F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")))
    )
    words = F.least(F.col("stop"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block)
    # source and place name a document with words; texts are not needed
    found = (
        parts.withColumn("words", words)
        .join(ranked, same("source", "_source") & (F.col("rank") == F.col("_rank")))
        .groupBy("_source", F.col("at").alias("_at"))
        .agg(F.sum("words").alias("taken"), *[F.min(F.when(F.col("round") == r, F.col("slot"))).alias(f"slot{r}") for r in range(REPEATS)])
    )
    out = placed.join(found, same("source", "_source") & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    return out.select(
        "doc_id", "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.array(*[f"slot{r}" for r in range(REPEATS)]).alias("slots"),
    )


def mixed_rows(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, point: Callable[[Column], Column] = golden_point
) -> DataFrame:
    """Returns (doc_id, size, source_size, target, taken, first_slot) for every row of ``docs`` (doc_id, source, text).

    Size: runs of anything but space and tab to carriage return (null and empty texts: 0). ``targets`` has
    the source's target; taken is the number of the document's words in the mix, repeats counted: between
    0 and REPEATS times its size, and over a source less than a word off its target. first_slot is the place in the mix
    where its words come first, null if none is taken. Null is a source of its own. The
    order within a source is by md5 of doc_id, then doc_id, size and text, so reruns agree; repeated rows stand
    one behind the other. An empty table gives no rows; if all sizes are 0, nothing is taken.
    """
    out = _mixed(docs, weights, block, point)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, slot: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: words taken by size, rounded, at least once if any
    word is taken. A document without words is not taken. Columns stay as they are, whatever their names;
    ``slot``, if given, is a column more: the place of each copy in the schedule, by which the mix is put in
    order. Rows of one id with other texts or sources are told apart; those that agree in all three
    come as often as the one with the most words taken."""
    times = _mixed(docs, weights, block, golden_point).where("taken > 0").groupBy("doc_id", "mark").agg(
        F.max(F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")))).cast("int").alias("times"),
        F.array(*[F.min(F.col("slots")[r]) for r in range(REPEATS)]).alias("slots"),
    )
    # the copies of rows with words begin with the first time the source is gone through that has them
    copies = times.select(
        F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"),
        F.expr("slice(filter(slots, s -> s is not null), 1, times)").alias("slots"),
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _mark().alias("mark"))
    often = rows.join(copies, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")))
    often = often.select("row", F.explode("slots").alias("slot"))
    return often.select("row.*", *([F.col("slot").alias(slot)] if slot else []))
