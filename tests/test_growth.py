"""Plans and state that must not grow faster than the tables."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa

from tillroll.operators import logs
from tillroll.plans.ledger import Ledger
from tillroll.sources import records
from tillroll.streaming import packs, workers
from tillroll.streaming import pipelines as P
from tillroll.streaming.replay import Replay, accepted_records
from tillroll.streaming.state import Balances, DistrictQueue, ints, kept
from tests.conftest import TINY, rows
from tests.test_queries import plan


def test_the_stock_table_is_never_broadcast(spark):
    x = Ledger(spark, TINY)
    lines = spark.createDataFrame([(1, 7, 3, 1), (2, 8, 3, 2)], "txn bigint, item bigint, supply_w int, d int")
    asked = lines.selectExpr("supply_w as w", "item")
    for joined in (x.with_dist_info(lines), logs.lookup_strict(asked, x.opening_stock, ["w", "item"])):
        assert "Broadcast" not in plan(joined)
        assert joined.count() == 2


class Counted:
    """A value or a map of state, in memory, that counts how often it is asked."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def _call(self, act, key, *value):
        self.calls += 1
        return act(key, *value)

    def exists(self):
        return self._call(self.values.__contains__, None)

    def get(self):
        return self._call(self.values.__getitem__, None)

    def update(self, value):
        self._call(self.values.__setitem__, None, value)

    def containsKey(self, key):
        return self._call(self.values.__contains__, key)

    def getValue(self, key):
        return self._call(self.values.__getitem__, key)

    def updateValue(self, key, value):
        self._call(self.values.__setitem__, key, value)

    def removeKey(self, key):
        self._call(self.values.__delitem__, key)


def test_a_districts_queue_asks_its_state_by_blocks_of_orders():
    q = DistrictQueue()
    q._ends, q._waiting = Counted(), Counted()
    n, got = 2000, []
    placed = pd.DataFrame({"kind": 0, "ts": range(n), "txn": range(n), "c": range(100, 100 + n), "total_cents": range(n), "carrier": None, "w": 1, "d": 1})
    polls = pd.DataFrame({"kind": 1, "ts": range(n, 2 * n + 5), "txn": range(n + 5), "c": None, "total_cents": None, "carrier": 4, "w": 1, "d": 1})
    for part in (placed, polls):
        for out in q.handleInputRows((1, 1), iter([part]), None):
            got += list(out[["kind", "order_id", "c", "total_cents"]].itertuples(index=False, name=None))
    assert got == [(kind, i + 1, 100 + i, i) for kind in (0, 1) for i in range(n)]
    assert q._waiting.calls < n / 10 and len(q._waiting.values) <= 1


def test_balances_of_many_customers_are_one_state():
    b = Balances(-1000)
    b._cents = Counted()
    want, draw = {}, random.Random(5)
    for batch in range(3):
        rows = [(draw.randrange(50) * 7, t, 2, draw.randrange(-500, 500)) for t in range(batch * 200, batch * 200 + 200)]
        part = pd.DataFrame(rows, columns=["c", "ts", "kind", "change_cents"]).assign(w=1, d=1, txn=1)
        told = [tuple(r) for out in b.handleInputRows((1, 1, 0), iter([part]), None) for r in out[["ts", "c", "balance_cents"]].itertuples(index=False)]
        expected = []
        for c, ts, _, change in rows:
            want[c] = want.get(c, -1000) + change
            expected.append((ts, c, want[c]))
        assert sorted(told) == expected
    assert b._cents.calls <= 5 * 3


def test_customers_without_a_warehouse_are_one_slot_in_log_order(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("log", "out", "cp")}
    schema = "w int, d int, c bigint, ts bigint, kind int, txn bigint, change_cents bigint"
    n = 3000  # more than an Arrow batch, the newest first
    log = spark.range(n, 0, -1, 1).selectExpr("cast(null as int) as w", "1 as d", "id % 2 as c", "id as ts", "2 as kind", "id as txn", "1L as change_cents")
    log.write.parquet(at["log"])
    start = spark.createDataFrame([(None, 1, 1, 70)], "w int, d int, c bigint, cents bigint")
    P.start_log(P.balance_stream(records.stream_log(spark, at["log"], schema), 0, start), at["out"], at["cp"]).awaitTermination()
    got = rows(spark.read.parquet(at["out"]), "ts", "balance_cents")
    assert got == sorted(((t, (t + 1) // 2 + 70 * (t % 2)) for t in range(1, n + 1)), key=repr)


def test_numbers_of_a_state_are_kept_small():
    draw = np.random.default_rng(1)
    item = np.flatnonzero(draw.random(100_000) < 0.7) + 10**9
    shelf = np.stack([item, draw.integers(10, 101, len(item))])
    assert (ints(kept(shelf), 2) == shelf).all() and len(kept(shelf)) < 3 * len(item)  # 16 as they are
    ends = np.iinfo("int64")
    for numbers in (np.zeros((3, 0), dtype="int64"), np.array([[ends.min, -1, 0, ends.max], [5, ends.max, ends.min, 0]]), np.array([[7], [-3], [0]])):
        assert (ints(kept(numbers), len(numbers)) == numbers).all()
    assert ints(None, 4).shape == (4, 0)


def test_a_slice_is_moved_into_its_log(spark, tmp_path):
    source, log = str(tmp_path / "dealt" / "slice=0"), str(tmp_path / "log")
    assert not records.move_into_log(spark, source, log)
    spark.range(5).write.parquet(source)
    assert records.move_into_log(spark, source, log)
    assert not (tmp_path / "dealt" / "slice=0").exists() and rows(records.read_log(spark, log, "id long"), "id") == [(i,) for i in range(5)]


def test_the_files_of_a_log_are_not_written_twice(spark):
    replay = Replay(Ledger(spark, TINY)).run(lambda r: None)
    folder = replay.folder.removeprefix("file:")
    assert not list(Path(folder, "log").rglob("*.parquet")) and list(Path(folder, "accepted").rglob("*.parquet"))
    assert replay.read("accepted", P.ACCEPTED).count() == accepted_records(replay.x).count()
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "100"


def test_a_copy_is_one_of_the_same_two_hashes():
    class Seen(Counted):
        def iterator(self):
            return iter([(k, v) for k, v in self.values.items()])

    f = workers.FirstCopies(1, ["n"])
    f._seen, f._blocks = Seen(), Counted()

    def told(*pairs):
        table = pa.table({"h1": [p[0] for p in pairs], "h2": [p[1] for p in pairs], "n": list(range(len(pairs)))})
        return [n for out in f.handleInputRows(None, iter([pd.DataFrame({"rows": [packs.closed(table)]})]), None) for n in packs.opened(out["rows"][0])["n"].to_pylist()]

    assert told((9, 1), (-5, 1), (9, 1), (9, 2)) == [0, 1, 3]
    assert told((9, 2), (9, 3), (-5, 1), (7, 1)) == [1, 3]
    assert told((9, 3), (9, 1), (7, 1)) == []
