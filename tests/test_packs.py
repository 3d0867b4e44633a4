"""Rows in packs: few rows for many, and every one of them again."""

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.sources import records
from tillroll.streaming import packs
from tillroll.streaming import pipelines as P
from tillroll.streaming import workers as W

SCHEMA = "k int, n bigint, text string, price decimal(12,2)"


def many(spark, n):
    """A tenth has no key."""
    return spark.range(0, n, 1, 3).selectExpr(
        "cast(if(id % 10 = 0, null, id % 3) as int) as k", "if(id % 7 = 0, null, id) as n", "if(id % 5 = 0, null, id || 'é') as text",
        "cast(id / 4 as decimal(12,2)) as price",
    )


def test_packs_are_few_and_hold_every_row(spark):
    df = many(spark, 9000)
    packed = packs.packed(df, F.col("k"), at="n").cache()
    assert packed.count() <= 3 * 4 and {r.key for r in packed.select("key").distinct().collect()} == {"0", "1", "2", "-"}
    newest = {r["key"]: r["at"] for r in packed.groupBy("key").agg(F.max("at").alias("at")).collect()}
    assert newest == {r["key"]: r["n"] for r in df.groupBy(packs.key_of(F.col("k")).alias("key")).agg(F.max("n").alias("n")).collect()}
    got = packs.unpacked(packed.select("rows"), SCHEMA)
    assert rows(got, "k", "n", "text", "price") == rows(df, "k", "n", "text", "price")


class Calls(P.RecentOrders):
    """Tells how many rows it is given at once."""

    def init(self, handle):
        pass

    def handleInputRows(self, key, rows, timerValues):
        sizes = [len(part) for part in rows]
        yield pd.DataFrame({"k": [key[0]], "calls": [len(sizes)], "n": [sum(sizes)]})


def test_an_operator_gets_a_keys_rows_in_one_call(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    many(spark, 9000).write.parquet(at["in"])
    stream = packs.packed(records.stream_log(spark, at["in"], SCHEMA), F.col("k")).groupBy("key").transformWithStateInPandas(
        packs.Packed(Calls(1), ["k"]), "k int, calls int, n int", outputMode="Append", timeMode="None"
    )
    P.start_log(stream, at["out"], at["cp"]).awaitTermination()
    assert rows(spark.read.parquet(at["out"]), "k", "calls", "n") == sorted([(k, 1, 2700) for k in range(3)] + [(None, 1, 900)], key=repr)


def test_the_streams_shuffle_packs(spark, tmp_path):
    def log(schema):
        return records.stream_log(spark, str(tmp_path), schema)

    accepted, district = log(P.ACCEPTED + ", n_lines bigint"), log(P.DISTRICT_LOG)
    changes, modified = log(W.LINES + ", change_cents bigint"), log(W.MODIFICATION)
    for stream in (
        P.district_stream(accepted), P.recent_stream(district), P.balance_stream(changes, 0), W.worker_stream(accepted, log(W.LINES)),
        W.merged_stream(log(W.RESULT)), W.first_copies(modified, W.MODIFICATION_KEY), W.stock_level_stream(modified, modified, F.lit(10)),
    ):
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert plan.count("TransformWithStateInPySpark") <= plan.count("MapInArrow pack")
