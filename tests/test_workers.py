"""The workers' logs, merged results, views and stock levels, batch by batch, against plain Python."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillroll.sources import records
from tillroll.streaming import pipelines as P
from tillroll.streaming import workers as W


class Value:
    """A processor's state, in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Values:
    def __init__(self):
        self.values = {}

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]


def worker():
    w = W.Worker()
    w._shelf, w._ends, w._waiting = Value(), Value(), Values()
    return w


def feed(processor, key, parts):
    for part in parts:
        for out in processor.handleInputRows(key, iter([part]), None):
            yield from out.to_dict("records")


def cut(rng, frame, n):
    """The frame's rows in ``n`` batches, each in any order."""
    at = sorted(rng.sample(range(1, len(frame)), n - 1))
    return [frame.iloc[a:b].sample(frac=1, random_state=a) for a, b in zip([0, *at], [*at, len(frame)])]


@pytest.mark.parametrize("most", [10, 400])
def test_a_shelf_equals_step_by_step(most):
    rng = random.Random(most)
    moves = pd.DataFrame(
        [(7, i // 3, i, 0, rng.choice(["home", "supply", "look"]), rng.randrange(most + 1)) for i in range(400)],
        columns=["w", "ts", "txn", "line", "role", "taken"],
    )
    moves["item"] = [rng.randrange(12) for _ in range(len(moves))]
    moves["opening"] = moves["item"] + 10
    moves.loc[moves.role == "look", "taken"] = 0
    level, want = {}, {}
    for m in moves.itertuples():
        now = level.get(m.item, m.opening)
        if m.role != "look":
            now = now - m.taken + (91 if now - m.taken < 10 else 0)
            level[m.item] = now
        want[m.txn] = now
    got = {r["txn"]: r["level"] for r in feed(worker(), ("stock", 7, 0), cut(rng, moves, 9))}
    assert got == want


def test_a_queue_equals_step_by_step():
    rng = random.Random(5)
    events = pd.DataFrame(
        [(i // 2, 0 if rng.random() < (0.7 if i < 1500 else 0.3) else 1, i) for i in range(3000)], columns=["ts", "kind", "txn"]
    ).sort_values(["ts", "kind", "txn"], ignore_index=True)
    events = events.assign(w=3, d=4, c=events.txn * 3, total_cents=events.txn * 7, carrier=2)
    events.loc[events.kind == 1, ["c", "total_cents"]] = None
    queue, want, next_id = [], [], 1
    for e in events.itertuples():
        if e.kind == 0:
            queue.append((next_id, e.c, e.total_cents))
            want.append((e.txn, next_id, e.c, e.total_cents))
            next_id += 1
        else:
            want.append((e.txn, *(queue.pop(0) if queue else (None, None, None))))
    w = worker()
    # in log order, as slices of time are
    edges = [0, *sorted(rng.sample(range(1, 3000), 20)), 3000]
    parts = [events.iloc[a:b].sample(frac=1, random_state=a) for a, b in zip(edges, edges[1:])]
    got = [(r["txn"], r["order_id"], r["c"], r["total_cents"]) for r in feed(w, ("queue", 3, 4), parts)]
    # rows of one moment may fall in two batches: their order is the batches' then
    plain = lambda t: [None if v is None or v != v else int(v) for v in t]
    got, want = sorted(map(plain, got), key=str), sorted(map(plain, want), key=str)
    assert [g[0] for g in got] == [x[0] for x in want]
    assert sorted(g[1] for g in got if g[1]) == sorted(x[1] for x in want if x[1])
    paid = {g[1]: g[2:] for g in got if g[1]}
    assert all(paid[x[1]] == x[2:] for x in want if x[1])
    assert w._ends.get() == (next_id, len(queue)) and len(w._waiting.values) <= len(queue) // W.BLOCK + 2


def test_stock_levels_stay_right(monkeypatch):
    """After each batch of a modification log, with rows out of order and repeated."""
    rng = random.Random(8)
    log, order_id = [], defaultdict(int)
    for txn in range(1, 160):
        d = rng.randrange(1, 4)
        order_id[d] += 1
        log.append((1, d, txn, txn, order_id[d], None, None, None))
        for line in range(rng.randrange(5)):
            log.append((1, d, txn, txn, None, line, rng.randrange(40), rng.randrange(10, 100)))
    frame = pd.DataFrame(log, columns=["w", "d", "txn", "ts", "order_id", "line", "item", "level"])
    wanted, low = {d: W.WantedItems(5) for d in (1, 2, 3)}, W.LowStock()
    low._state = Value()
    for p in wanted.values():
        p._state = Value()
    answer, edges = defaultdict(int), [0, 1, 7, 30, 90, 91, 200, len(frame)]
    for a, b in zip(edges, edges[1:]):
        part = pd.concat([frame.iloc[a:b], frame.iloc[max(0, a - 5) : a]]).sample(frac=1, random_state=a)
        news = []
        for d, mine in part.groupby("d"):
            for r in feed(wanted[d], (1, d), [mine]):
                news.append({**r, "threshold": 20 + 10 * d})
        levels = part[part.level.notna()].drop(columns=["d", "order_id"])
        batch = pd.concat([levels, pd.DataFrame(news, columns=["w", "d", "item", "wanted", "threshold"])])
        if len(batch):
            for r in feed(low, (1, 0), [batch]):
                answer[r["d"]] += r["change"]
        seen = frame.iloc[:b]
        lines = seen[seen.level.notna()]
        last = lines.sort_values(["ts", "txn", "line"]).groupby("item")["level"].last()
        for d in (1, 2, 3):
            newest = seen[(seen.d == d) & seen.order_id.notna()].sort_values("order_id").txn.tail(5)
            items = set(lines[lines.txn.isin(newest) & (lines.d == d)].item)
            assert answer[d] == sum(last[i] < 20 + 10 * d for i in items)


RESULT_ROWS = "type string, txn long, ts long, w int, line int, seq int, parts int, order_id long, item_name string, stock_quantity int"


def test_results_wait_and_time_out(spark, tmp_path):
    base = 1_600_000_000_000
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    steps = [
        # the second order's level is missing, the third's header; a payment is whole at once
        [("neworder", 1, base, 1, -1, 0, 3, 11, None, None), ("neworder", 1, base, 1, 0, 0, None, None, "pen", None),
         ("neworder", 2, base, 1, -1, 0, 3, 12, None, None), ("neworder", 2, base, 1, 0, 0, None, None, "ink", None),
         ("neworder", 3, base, 2, 0, 1, None, None, None, 55), ("payment", 1, base, 4, -1, 0, 1, None, None, None)],
        # another warehouse, in time; and a repeat
        [("neworder", 1, base, 2, 0, 1, None, None, None, 70), ("neworder", 2, base, 1, 0, 0, None, None, "ink", None)],
        # the log moves on
        [("payment", 9, base + 3_600_000, 4, -1, 0, 1, None, None, None)],
        [("payment", 10, base + 7_200_000, 4, -1, 0, 1, None, None, None)],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    done = []
    for step in steps:
        W.fit(spark.createDataFrame(step, RESULT_ROWS), W.RESULT).write.mode("append").parquet(at["in"])
        results = records.stream_log(spark, at["in"], W.RESULT)
        P.start_log(W.merged_stream(results, 90_000, "1 minute", 3), at["out"], at["cp"]).awaitTermination()
        done.append(spark.read.parquet(at["out"]).select("type", "txn", "status").distinct().count())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = rows(spark.read.parquet(at["out"]), "type", "txn", "line", "status", "order_id", "item_name", "stock_quantity")
    assert got == sorted([
        ("neworder", 1, -1, "complete", 11, None, None), ("neworder", 1, 0, "complete", None, "pen", 70),
        ("neworder", 2, -1, "timeout", 12, None, None), ("neworder", 2, 0, "timeout", None, "ink", None),
        ("neworder", 3, 0, "timeout", None, None, 55), *(("payment", t, -1, "complete", None, None, None) for t in (1, 9, 10)),
    ], key=repr)
    # whole ones at once, the others only when their time was up
    assert done[0] == 1 and done[1] == 2


def test_repeats_are_left_out_and_forgotten(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    sizes = []
    for part in ([(1, "a"), (1, "a"), (2, None)], [(2, None), (3, "a")], [(1, "a"), (3, "b"), (3, "a"), (None, "a")], [(None, "a")]):
        spark.createDataFrame(part, "k long, v string").write.mode("append").parquet(at["in"])
        log = records.stream_log(spark, at["in"], "k long, v string")
        with W.once(spark):
            P.start_log(W.first_copies(log, ["k", "v"], remembered_ms=3_600_000, buckets=2), at["out"], at["cp"]).awaitTermination()
        sizes.append(P.read_state(spark, at["cp"], "seen").count())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows(spark.read.parquet(at["out"]), "k", "v") == sorted([(1, "a"), (2, None), (3, "a"), (3, "b"), (None, "a")], key=repr)
    assert max(sizes) <= 4 * 2


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    """The sink replaces a batch's rows in every log."""
    at = str(tmp_path / "in")
    path = lambda name: str(tmp_path / "logs" / name)
    spark.range(10).write.parquet(at)

    def split(batch):
        return {"even": batch.where("id % 2 = 0"), "all": batch.withColumn("twice", F.col("id") * 2)}

    for run in range(2):  # a new checkpoint: batch 0 once more
        stream = records.stream_log(spark, at, "id long")
        W.start_split(stream, split, path, "worker", str(tmp_path / f"cp{run}")).awaitTermination()
    assert rows(spark.read.parquet(path("even")), "id") == [(i,) for i in (0, 2, 4, 6, 8)]
    assert spark.read.parquet(path("all")).agg(F.sum("twice"), F.count("*")).first()[:] == (90, 10)
    W.start_split(records.stream_log(spark, at, "id long"), split, path, "accounts", str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(path("all")).count() == 20


class Counted(Values):
    """State that counts its calls."""

    calls = 0

    def containsKey(self, key):
        Counted.calls += 1
        return super().containsKey(key)

    def updateValue(self, key, value):
        Counted.calls += 1
        return super().updateValue(key, value)


def test_a_slots_texts_take_one_call():
    """However many bad-credit customers a slot has, and the texts go on in the next batch."""
    class Handle:
        def getValueState(self, name, schema):
            made[name] = Value()
            return made[name]

        def getMapState(self, name, *schemas):
            raise AssertionError("a state call for each customer")

    made = {}
    accounts = W.Accounts(0)
    accounts.init(Handle())

    def paid(n, opening):
        return pd.DataFrame({
            "w": 1, "d": 1, "c": range(200), "ts": n, "kind": 2, "txn": range(200), "change_cents": -1, "pay_w": 1, "pay_d": 1,
            "bad": [c % 2 == 0 for c in range(200)], "prefix": [f"{n}:{c} " if c % 2 == 0 else None for c in range(200)], "opening_data": opening,
        })

    first, second = (next(accounts.handleInputRows((1, 1, 0), iter([paid(n, "old")]), None)).set_index("c") for n in (1, 2))
    assert first.data[4] == "1:4 old" and second.data[4] == "2:4 1:4 old" and second.data[5] == "old"
    assert set(second.balance_cents) == {-2} and W.opened(made["texts"].get()[0]).num_rows == 100


def test_a_queue_takes_few_calls():
    """A state call for a block of some thousand orders, not one for each 256."""
    Counted.calls = 0
    w = worker()
    w._waiting = Counted()
    n = 10_000
    placed = pd.DataFrame({"kind": 0, "ts": range(n), "txn": range(n), "c": range(n), "total_cents": range(n), "w": 3, "d": 4})
    polled = pd.DataFrame({"kind": 1, "ts": n, "txn": range(5_000), "c": None, "total_cents": None, "w": 3, "d": 4})
    list(feed(w, ("queue", 3, 4), [placed]))
    assert Counted.calls <= 8
    got = [r["order_id"] for r in feed(w, ("queue", 3, 4), [polled])]
    assert got == list(range(1, 5_001))


def test_newest_orders_of_many():
    recent = P.RecentOrders(20)
    recent._orders = Value()
    recent._orders.put = recent._orders.update
    want, rng = [], random.Random(3)
    for _ in range(3):
        ids = [rng.randrange(5_000) for _ in range(3_000)]
        part = pd.DataFrame({"order_id": ids + ids[:50], "txn": [i * 7 for i in ids + ids[:50]], "c": 5})
        want = sorted({*want, *zip(part.order_id, part.txn, part.c)})[-20:]
        kept = next(recent.handleInputRows((1, 2), iter([part]), None))
        assert list(zip(kept.order_id, kept.txn, kept.c)) == want and set(kept.newest) == {want[-1][0]}


def test_different_numbers():
    rng = W.np.random.default_rng(2)
    for n in (0, 1, 500):
        numbers = rng.integers(0, 6, (3, n))
        assert (W.distinct(numbers) == W.np.unique(numbers, axis=1)).all()


def test_a_worker_gives_packs_of_its_rows():
    """A row for each key goes back to Spark, and what is in it is what the worker gives row by row."""
    rng = random.Random(4)
    moves = pd.DataFrame(
        [(7, i // 3, i, 0, 1, rng.randrange(12), 7, 8, rng.randrange(11), rng.choice(["home", "supply", "look"])) for i in range(400)],
        columns=["w", "ts", "txn", "line", "d", "item", "home_w", "supply_w", "quantity", "role"],
    )
    moves = moves.assign(taken=moves.quantity.where(moves.role != "look", 0), opening=moves["item"] + 10)
    events = pd.DataFrame({"w": 3, "d": 4, "ts": range(60), "kind": [0, 0, 1] * 20, "txn": range(60), "carrier": 2, "n_lines": 5})
    events = events.assign(c=(events.txn * 3).where(events.kind == 0), total_cents=(events.txn * 7).where(events.kind == 0))
    events = pd.concat([events[events.kind == 1].assign(ts=-1, txn=100 + events.txn), events])
    for key, frame, place, columns in ((("stock", 7, 0), moves, "stock", ["txn", "role", "level"]), (("queue", 3, 4), events, "queue", ["txn", "order_id", "c", "total_cents"])):
        want, plain = [], worker()
        packs, w = [], W.PackedWorker()
        w._shelf, w._ends, w._waiting = Value(), Value(), Values()
        for part in cut(rng, frame, 3):
            want += [tuple(None if v != v else v for v in r) for out in plain.handleInputRows(key, iter([part]), None) for r in out[columns].itertuples(index=False)]
            given = pd.DataFrame({"rows": [W.closed(W.pa.Table.from_pandas(p, preserve_index=False)) for p in (part[:5], part[5:])]})
            packs += [r for out in w.handleInputRows(("x",), iter([given]), None) for r in out.itertuples(index=False)]
        assert len(packs) == 3 and {p.place for p in packs} == {place}
        got = [tuple(r[c] for c in columns) for p in packs for r in W.opened(p.rows).to_pylist()]
        assert got == want and len(got) == len(frame)


def test_the_text_of_one_district(spark):
    texts = W.generate.stock_texts(F.col("w"), F.col("item"))
    one = W.generate.stock_text(F.col("w"), F.col("item"), F.col("d"))
    some = spark.createDataFrame([(w, 10**i, d) for w in (1, 25, None) for i in range(4) for d in range(1, 11)] + [(1, 2, None)], "w int, item bigint, d int")
    told = some.select(one.alias("one"), F.element_at(texts, F.col("d")).alias("all"))
    got = told.collect()
    assert len(got) == 121 and all(r["one"] == r["all"] for r in got)
