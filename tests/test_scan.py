"""Running sums against a plain loop, in one window and split into slices."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.operators import scan
from tillroll.operators.asof import join_asof
from tillroll.operators.scan import recent, running


def sample(n, seed):
    """One key has more than a third of the rows."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(8)}", i, rng.randrange(-5, 6)) for i in rng.sample(range(n * 3), n)]


def by_loop(data):
    out, groups = [], defaultdict(list)
    for k, t, v in data:
        groups[k].append((t, v))
    for k, group in groups.items():
        total, low = 0, None
        for t, v in sorted(group):
            total += v
            out.append((k, t, total, low))
            low = total if low is None else min(low, total)
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [10_000, 60])
def test_sums_and_floors(spark, hot_rows):
    data = sample(400, 1)
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(5)
    out = running(df, ["k"], ["t"], {"total": F.col("v")}, {"low": F.col("total")}, hot_rows=hot_rows)
    assert rows(out, "k", "t", "total", "low") == by_loop(data)


def test_one_key_holding_everything_is_split(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    out = running(df, ["k"], ["t"], {"n": F.lit(1)}, hot_rows=100)
    assert rows(out, "t", "n") == sorted([(i, i + 1) for i in range(1000)], key=repr)
    sizes = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 700


def test_exact_copies_get_numbers_of_their_own(spark):
    df = spark.range(500).select(F.lit("x").alias("k"), F.lit(7).alias("t"))
    out = running(df, ["k"], ["t"], {"n": F.lit(1)}, hot_rows=50, ties=True)
    assert sorted(r.n for r in out.collect()) == list(range(1, 501))


def test_both_ways_have_the_same_schema(spark):
    df = spark.createDataFrame([("a", 1, Decimal(2))] * 9, "k string, t int, v decimal(12,2)")
    plain = running(df, ["k"], ["t"], {"s": F.col("v")}, hot_rows=100)
    split = running(df, ["k"], ["t"], {"s": F.col("v")}, hot_rows=4)
    assert [(f.name, f.dataType) for f in plain.schema] == [(f.name, f.dataType) for f in split.schema]


def test_coarser_sizes_and_row_bounds(spark):
    data = [("a", i % 3, i) for i in range(90)] + [("b", 0, i) for i in range(5)]
    df = spark.createDataFrame(data, "k string, j int, t int")
    by_k = lambda: df.groupBy("k").agg(F.count("*").alias("n"))
    want = rows(running(df, ["k", "j"], ["t"], {"n": F.lit(1)}), "k", "j", "t", "n")
    assert rows(running(df, ["k", "j"], ["t"], {"n": F.lit(1)}, sizes=by_k, hot_rows=20), "k", "j", "t", "n") == want
    never = lambda: pytest.fail("not asked for when the row bound is small")
    assert rows(running(df, ["k", "j"], ["t"], {"n": F.lit(1)}, rows=95, sizes=never, hot_rows=95), "k", "j", "t", "n") == want


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_recent_looks_back_over_blocks(spark, block_rows):
    df = spark.range(1, 41).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    out = recent(df, ["k"], "n", F.col("n"), 5, "last", block_rows=block_rows)
    got = {r.n: r["last"] for r in out.collect()}
    assert got == {i: list(range(max(1, i - 4), i + 1)) for i in range(1, 41)}


@pytest.mark.parametrize("hot_rows", [10_000, 40])
def test_folds(spark, hot_rows):
    rng = random.Random(7)
    data = [(k if k != "k3" else None, t, v if rng.random() < 0.5 else None) for k, t, v in sample(300, 3)]
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(5)
    v = F.col("v")
    folds = {"last": scan.latest(v), "top": scan.highest(v), "low": scan.lowest(v), "n": scan.number(v), "any": scan.seen(v > 3)}
    got = rows(scan.folded(df, ["k"], ["t"], folds, hot_rows=hot_rows), "k", "t", *folds)
    want = []
    groups = defaultdict(list)
    for k, t, value in data:
        groups[k].append((t, value))
    for k, group in groups.items():
        upto = []
        for t, value in sorted(group, key=lambda r: r[0]):
            upto += [value] if value is not None else []
            want.append((k, t, upto[-1] if upto else None, max(upto, default=None), min(upto, default=None), len(upto),
                         any(x > 3 for x in upto) if upto else None))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_rows", [10_000, 30])
def test_join_asof(spark, hot_rows, strict):
    rng = random.Random(5)

    def some(n):
        key = lambda: rng.choice(["hot", "hot", "a", "b", None])
        return [(key(), rng.choice([None, *range(20)]), i) for i in range(n)]

    asks, says = some(150), some(60)
    # repeated rows are rows of their own, on both sides
    asks, says = asks + asks[:10], says + says[:5]
    left = spark.createDataFrame(asks, "k string, t int, _left int")
    right = spark.createDataFrame(says, "k string, t int, price int")
    got = rows(join_asof(left, right, ["k"], "t", strict, hot_rows=hot_rows), "k", "t", "_left", "price")
    want = []
    for k, t, i in asks:
        met = [(t2, p) for k2, t2, p in says if None not in (k, t, t2) and k2 == k and (t2 < t or t2 == t and not strict)]
        want.append((k, t, i, max(met)[1] if met else None))
    assert got == sorted(want, key=repr)


def test_join_asof_empty_and_clashing(spark):
    left = spark.createDataFrame([("a", 1)], "k string, t int")
    empty = spark.createDataFrame([], "k string, t int, price int")
    assert rows(join_asof(left, empty, ["k"], "t"), "k", "t", "price") == [("a", 1, None)]
    assert join_asof(left.where("false"), empty, ["k"], "t").count() == 0
    with pytest.raises(ValueError, match="price"):
        join_asof(left.withColumn("price", F.lit(1)), empty, ["k"], "t")
