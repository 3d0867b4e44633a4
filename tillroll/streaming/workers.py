"""Workers whose rows go to the modification log and to the result log, and what is built on those logs.

The worker is one stateful operator for stock and queues. Each micro-batch of it is split over its logs in one
commit: a folder per batch id and log, replaced when the batch is run again, so that a batch counts once; a reader
that has seen the earlier files drops repeats by key. Accounts are a second operator, fed by the first one's deliveries.

State is kept in blocks (a shelf of items, a run of order ids, a bucket of transactions) as packed numbers, so
that a micro-batch costs a few state calls for each block it touches, not for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillroll.functions.text import bad_credit_prefix
from tillroll.operators import modifications, orders, stock
from tillroll.operators.accounts import DATA_LIMIT, DATA_SHOWN
from tillroll.operators.results import TIMEOUT_MS
from tillroll.operators.stock import LOWEST, RESTOCK
from tillroll.sources import generate, records
from tillroll.sources.shop import DISTRICTS, PAYMENT, initial_stock
from tillroll.streaming import pipelines as P
from tillroll.streaming.packs import PACKED, Packed, closed, opened, packed, rows_of, unpacked
from tillroll.streaming.state import BLOCK, Balances, ints, kept, take_turns

#: Items of a shelf, buckets that transactions are dealt over.
SHELF = 262_144
BUCKETS = 256
#: How long a modification is remembered, so that it can be told from a repeat of it.
REMEMBERED_MS = 24 * 3_600_000

LINES = "txn bigint, ts bigint, w int, d int, c bigint, line int, item bigint, supply_w int, quantity int"
MOVED = "w int, d int, ts bigint, txn bigint, line int, item bigint, home_w int, supply_w int, quantity int, role string, level int"
QUEUED = (
    "w int, d int, ts bigint, kind int, txn bigint, order_id bigint, c bigint, total_cents bigint, carrier int, n_lines bigint"
)
WORKED = f"place string, {PACKED}"
_STOCK, _QUEUE = "stock", "queue"
#: Rows of a pack that a worker gives.
PACK_ROWS = 1_000_000


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def in_order(batch: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The rows sorted by the columns, which are numbers; nulls come last."""
    return batch.take(np.lexsort([batch[c].to_numpy() for c in reversed(columns)])).reset_index(drop=True)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different columns of an array, in ascending order, the first row's numbers first."""
    numbers = numbers[:, np.lexsort(numbers[::-1])]
    new = np.ones(numbers.shape[1], dtype=bool)
    new[1:] = (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)
    return numbers[:, new]


# ---- the worker ------------------------------------------------------------------


def worker_events(accepted: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What happens to shelves and to queues. ``accepted`` has headers (P.ACCEPTED; n_lines where lines are not in it), ``lines`` the
    orders' lines (LINES)."""
    if "n_lines" not in accepted.columns:
        accepted = accepted.withColumn("n_lines", F.size("lines").cast("bigint"))
    moved = stock.movements(lines, any_quantity=True).select(
        F.col("stock_w").alias("w"), "ts", "txn", "line", "d", "item", F.col("w").alias("home_w"), "supply_w", "quantity", "role", "taken",
        initial_stock(F.col("item")).alias("opening"),
    )
    return moved, P.district_events(accepted, "n_lines")


def worker_stream(accepted: DataFrame, lines: DataFrame) -> DataFrame:
    """Stock levels after each movement (MOVED), numbered orders, and what each district gave to a delivery (QUEUED; order_id null:
    nothing), in one stream of packs (WORKED)."""
    moved, queued = worker_events(accepted, lines)
    # each with its own columns only
    shelves = packed(moved, F.lit(_STOCK), F.col("w"), F.floor(F.col("item") / SHELF))
    queues = packed(queued, F.lit(_QUEUE), F.col("w"), F.col("d"))
    return shelves.unionByName(queues).groupBy("key").transformWithStateInPandas(
        PackedWorker(), WORKED, outputMode="Append", timeMode="None"
    )


class Worker(StatefulProcessor):
    """A shelf's stock or a district's queue, by the key's first part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._shelf = handle.getValueState("shelf", "levels binary")
        self._ends = handle.getValueState("ends", "next_id bigint, pending bigint")
        self._waiting = handle.getMapState("waiting", "block bigint", "orders binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        if key[0] == _QUEUE:
            yield self._queue(batch)
            return
        order, level = self._stock({n: batch[n].to_numpy() for n in self.read}, (batch["role"] == "look").to_numpy())
        yield batch.take(order).reset_index(drop=True).assign(level=level)

    #: columns that a level is worked out from, with the role
    read = ["item", "ts", "txn", "line", "opening", "taken"]

    def _stock(self, columns: dict[str, np.ndarray], look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' order by item and log order, and the level after each."""
        order = np.lexsort([columns[n] for n in ("line", "txn", "ts", "item")])
        item, opening, takes = (columns[n][order].astype("int64") for n in ("item", "opening", "taken"))
        known, levels = ints(self._shelf.get()[0] if self._shelf.exists() else None, 2)
        first = np.flatnonzero(np.diff(item, prepend=item[0] - 1))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(item))))
        start = opening[first]
        at = np.searchsorted(known, item[first])
        told = np.flatnonzero(at < len(known))
        told = told[known[at[told]] == item[first[told]]]
        start[told] = levels[at[told]]

        def total(values: np.ndarray) -> np.ndarray:
            sums = values.cumsum()
            return sums - (sums[first] - values[first])[group]

        taken = total(takes)
        served = total((~look[order]).astype("int64"))
        needed = np.maximum(0, -((start[group] - taken - LOWEST) // RESTOCK))
        # the least so far in each group: later groups are shifted below all earlier ones
        shift = group.astype("int64") << 40
        least = np.minimum.accumulate(needed - served - shift) + shift
        level = start[group] - taken + RESTOCK * (served + np.minimum(0, least))
        last = np.append(first[1:], len(item)) - 1
        changed = last[served[last] > 0]
        if len(changed):
            same = np.isin(known, item[changed])
            now = np.concatenate([known[~same], item[changed]]), np.concatenate([levels[~same], level[changed]])
            self._shelf.update((kept(np.stack(now)[:, np.argsort(now[0])]),))
        return order, level.astype("int32")

    def _queue(self, batch: pd.DataFrame) -> pd.DataFrame:
        batch = in_order(batch, ["ts", "kind", "txn"])
        order_id, c, total, is_order, hit = take_turns(self._ends, self._waiting, batch)
        known = is_order | hit

        def column(values: np.ndarray) -> np.ndarray:
            out = np.full(len(values), None, dtype=object)
            out[known] = values[known]
            return out

        return batch.assign(order_id=column(order_id), c=column(c), total_cents=column(total))

    def close(self) -> None:
        pass


class PackedWorker(Worker):
    """A worker that takes packs and gives packs: a shelf's rows stay in Arrow columns."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        table = rows_of(rows)
        if "role" in table.column_names:
            place = _STOCK
            look = pa.compute.equal(table["role"], "look").to_numpy()
            order, level = self._stock({n: table[n].to_numpy() for n in self.read}, look)
            out = table.select([n for n in _columns(MOVED) if n != "level"]).take(order).append_column("level", pa.array(level))
        else:
            place = _QUEUE
            out = pa.Table.from_pandas(self._queue(table.to_pandas())[_columns(QUEUED)], schema=_QUEUED_ROWS, preserve_index=False)
        for at in range(0, out.num_rows, PACK_ROWS):
            yield pd.DataFrame({"place": [place], "rows": [closed(out.slice(at, PACK_ROWS))]})


_QUEUED_ROWS = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64()}[kind]) for n, kind in (part.split() for part in QUEUED.split(", "))])


# ---- accounts ----------------------------------------------------------------------

ACCOUNTS = (
    "w int, d int, c bigint, ts bigint, kind int, txn bigint, change_cents bigint, balance_cents bigint, pay_w int, pay_d int, data string"
)


class Accounts(Balances):
    """Balance and text of a slot's customers after each payment and delivery. Texts are kept of bad-credit customers, who
    alone have theirs changed."""

    columns = _columns(ACCOUNTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._texts = handle.getValueState("texts", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch, customers, first = self._balanced(rows)
        data, prefixes = batch["opening_data"].to_numpy(dtype=object, copy=True), batch["prefix"].to_numpy()
        ends = np.append(first[1:], len(batch))
        texts, changed = None, False
        for i in np.flatnonzero(np.logical_or.reduceat(batch["bad"].to_numpy(dtype=bool), first)).tolist():
            if texts is None:
                texts = self._known_texts()
            c = int(customers[i])
            text = before = texts.get(c)
            for n in range(first[i], ends[i]):
                text = data[n] if text is None else text
                if prefixes[n] is not None:
                    text = (prefixes[n] + text)[:DATA_LIMIT]
                data[n] = text
            if text != before:
                texts[c], changed = text, True
        if changed:
            table = pa.table({"c": pa.array(texts.keys(), pa.int64()), "data": pa.array(texts.values(), pa.string())})
            self._texts.update((closed(table, "zstd"),))
        yield batch.assign(data=data)[self.columns]

    def _known_texts(self) -> dict[int, str]:
        """The slot's texts, kept together: a batch costs a state call a slot, not a few for each customer."""
        if not self._texts.exists():
            return {}
        table = opened(self._texts.get()[0])
        return dict(zip(table["c"].to_pylist(), table["data"].to_pylist()))


def account_stream(accepted: DataFrame, queue_log: DataFrame, middle: DataFrame, customers: DataFrame, opening_cents: int) -> DataFrame:
    """Payments and deliveries with the balance and the customer's text after each (ACCOUNTS)."""
    paid = P.resolved_payments(accepted, middle).select(
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c", "ts", F.lit(PAYMENT).alias("kind"), "txn",
        (-P.cents(F.col("amount"))).alias("change_cents"), F.col("w").alias("pay_w"), F.col("d").alias("pay_d"),
        bad_credit_prefix(*[F.col(x) for x in ("c", "c_d", "c_w", "d", "w", "amount")]).alias("prefix"),
    )
    owed = queue_log.where("kind = 1 and order_id is not null").select(
        "w", "d", "c", "ts", "kind", "txn", F.col("total_cents").alias("change_cents")
    )
    # texts are far larger than Spark takes them to be: never broadcast
    who = customers.select("w", "d", "c", F.col("credit").eqNullSafe("BC").alias("bad"), "opening_data").hint("merge")
    changes = paid.unionByName(owed, allowMissingColumns=True).join(who, ["w", "d", "c"], "left")
    # good customers' texts stay as they are
    changes = changes.withColumn("bad", F.coalesce("bad", F.lit(False))).withColumn("prefix", F.when(F.col("bad"), F.col("prefix")))
    return packed(changes, *P.slot()).groupBy("key").transformWithStateInPandas(
        Packed(Accounts(opening_cents), []), ACCOUNTS, outputMode="Append", timeMode="None"
    )


# ---- logs ----------------------------------------------------------------------------


def start_split(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], path: Callable[[str], str], source: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's rows to several logs: ``split`` names them, ``path`` says where they are, ``source`` tells this
    stream's part of a log from others'. A batch that is run again replaces what it wrote."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in split(batch).items():
                rows.write.mode("overwrite").parquet(f"{path(name)}/source={source}/batch={batch_id}", compression=records.CODEC)
        finally:
            batch.unpersist()

    return P._start(stream.writeStream.outputMode("append").foreachBatch(each), checkpoint)


def money(cents: Column) -> Column:
    return (cents / 100).cast("decimal(22,2)")


def moved_lines(worked: DataFrame, *roles: str) -> DataFrame:
    """The stock movements of these roles in the worker's packs, as ``stock.with_levels`` has them."""

    def wanted(table: pa.Table) -> pa.ChunkedArray:
        return pa.compute.is_in(table["role"], value_set=pa.array(roles))

    return unpacked(worked.where(F.col("place") == _STOCK).select("rows"), MOVED, wanted).select(
        "txn", "ts", F.col("home_w").alias("w"), "d", "line", "item", "supply_w", "quantity", "role", F.col("w").alias("stock_w"), "level"
    )


def queue_rows(worked: DataFrame) -> DataFrame:
    """What the worker's packs say of queues (QUEUED)."""
    return unpacked(worked.where(F.col("place") == _QUEUE).select("rows"), QUEUED)


def with_texts(lines: DataFrame) -> DataFrame:
    """Lines with the supplier's text for their district."""
    return lines.withColumn("dist_info", generate.stock_text(F.col("supply_w"), F.col("item"), F.col("d")))


def worked_modifications(worked: DataFrame, items: DataFrame) -> DataFrame:
    """The worker's rows of the modification log."""
    at_home = with_texts(orders.priced_lines(moved_lines(worked, "home", "look"), items))
    queued = queue_rows(worked).withColumn("total", money(F.col("total_cents")))
    out = modifications.order_modifications(queued.where("kind = 0"))
    for part in (modifications.stock_modifications(at_home, moved_lines(worked, "supply")), modifications.delivery_modifications(queued.where("kind = 1 and order_id is not null"))):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def account_modifications(changes: DataFrame) -> DataFrame:
    paid = changes.where(F.col("kind") == PAYMENT).select(
        "txn", "ts", F.col("w").alias("c_w"), F.col("d").alias("c_d"), "c", money(-F.col("change_cents")).alias("amount"),
        money(F.col("balance_cents")).alias("balance"), F.col("data").alias("customer_data"),
    )
    return modifications.payment_modifications(paid)


MODIFICATION = (
    "type string, txn bigint, modification_id int, ts bigint, w int, d int, c bigint, order_id bigint, amount decimal(22,2), line int, "
    "item bigint, supply_w int, quantity int, dist_info string, stock_level int, balance decimal(22,2), customer_data string, carrier int"
)
MODIFICATION_KEY = ["txn", "modification_id", "type", "line"]


def fit(log: DataFrame, schema: str) -> DataFrame:
    """The log's columns with the types of ``schema``, those it lacks null."""
    parts = [part.split() for part in schema.split(", ")]
    return log.select(*[(F.col(n) if n in log.columns else F.lit(None)).cast(t).alias(n) for n, t in parts])


# ---- results -----------------------------------------------------------------------------

RESULT = (
    "type string, txn bigint, ts bigint, w int, line int, seq int, parts int, order_id bigint, last string, credit string, discount double, "
    "w_tax double, d_tax double, item_name string, price decimal(12,2), amount decimal(22,2), stock_quantity int, c bigint, "
    "balance decimal(22,2), data string, d int, carrier int"
)
#: line of a result that is not a line's; a delivery has one for each district
HEADER = -1


def worked_results(worked: DataFrame, items: DataFrame, customers: DataFrame, warehouses: DataFrame, districts: DataFrame) -> DataFrame:
    """The worker's results, each from the warehouse that has it: an order's header, which tells how many ``parts`` the
    order's result comes in; of each line the price from its home and the level from its supplier; and of each delivery
    what it took from each district."""
    queued = queue_rows(worked)
    who = customers.select("w", "d", "c", "last", "credit", "discount")
    header = (
        queued.where("kind = 0").select("txn", "ts", "w", "d", "c", "order_id", "n_lines")
        .join(who, ["w", "d", "c"]).join(warehouses.select("w", "w_tax"), "w").join(districts.select("w", "d", "d_tax"), ["w", "d"])
        .select(
            F.lit("neworder").alias("type"), "txn", "ts", "w", F.lit(HEADER).alias("line"), F.lit(0).alias("seq"),
            # a line comes as a price and a level
            (1 + 2 * F.col("n_lines")).alias("parts"), "order_id", "last", "credit", "discount", "w_tax", "d_tax", "c", "d",
        )
    )
    named = orders.priced_lines(moved_lines(worked, "home", "look"), items).select(
        F.lit("neworder").alias("type"), "txn", "ts", "w", "line", F.lit(0).alias("seq"), "item_name", "price", "amount"
    )
    level = moved_lines(worked, "home", "supply").select(
        F.lit("neworder").alias("type"), "txn", "ts", F.col("stock_w").alias("w"), "line", F.lit(1).alias("seq"), F.col("level").alias("stock_quantity")
    )
    taken = queued.where("kind = 1").select(
        F.lit("delivery").alias("type"), "txn", "ts", "w", F.col("d").alias("line"), F.lit(0).alias("seq"), F.lit(DISTRICTS).alias("parts"),
        "d", "order_id", "carrier",
    )
    out = fit(header, RESULT)
    for part in (named, level, taken):
        out = out.unionByName(fit(part, RESULT))
    return out


def account_results(changes: DataFrame, customers: DataFrame) -> DataFrame:
    """The results of payments."""
    who = customers.select("w", "d", "c", "last", "credit", "discount")
    paid = changes.where(F.col("kind") == PAYMENT).join(who, ["w", "d", "c"]).select(
        F.lit("payment").alias("type"), "txn", "ts", "w", F.lit(HEADER).alias("line"), F.lit(0).alias("seq"), F.lit(1).alias("parts"),
        "last", "credit", "discount", money(-F.col("change_cents")).alias("amount"), "c", "d", money(F.col("balance_cents")).alias("balance"),
        F.when(F.col("credit") == "BC", F.substring("data", 1, DATA_SHOWN)).alias("data"),
    )
    return fit(paid, RESULT)


MERGED = RESULT.replace("parts int", "status string")


class WaitForAll(StatefulProcessor):
    """Puts the parts of transactions together, those of a bucket in one state.

    A transaction is complete when it has as many different parts as one of them says; then it comes out, a row for its
    header and one for each line, each field the last known one. One that is still waiting ``limit_ms`` after its time comes out
    with what there is, as a timeout; parts that come later come out by the same rule. A part that is repeated while its transaction waits counts once.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getValueState("waiting", "rows binary")

    def _waiting(self) -> pa.Table | None:
        return opened(self._rows.get()[0]) if self._rows.exists() else None

    def _keep(self, rows: pa.Table) -> None:
        if not rows.num_rows:
            self._rows.clear()
            return
        self._rows.update((closed(rows, "zstd"),))

    @staticmethod
    def _ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The different parts, the first copy of each, by transaction, line and seq; where each transaction and where
        each line starts."""
        values = []
        for name in ("type", "txn", "line", "seq"):
            column = rows[name].combine_chunks()
            if name == "type":
                column = column.dictionary_encode().indices
            values += [column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)]
        order = np.lexsort(values[::-1])
        changed = np.zeros(len(order), dtype=bool)
        changed[:1] = True
        starts = []
        for n, column in enumerate(values):
            column = column[order]
            changed[1:] |= column[1:] != column[:-1]
            if n in (3, 5):
                starts.append(changed.copy())
        return rows.take(order[changed]), *(np.flatnonzero(s[changed]) for s in starts)

    @staticmethod
    def _known(rows: pa.Table, starts: np.ndarray) -> np.ndarray:
        """Which transactions have a type and a number; others are never put together."""
        return np.logical_and.reduceat(
            (rows["type"].is_valid().to_numpy() & rows["txn"].is_valid().to_numpy()), starts
        )

    def _merged(self, rows: pa.Table, status: str) -> Iterator[pd.DataFrame]:
        if not rows.num_rows:
            return
        rows, _, starts = self._ordered(rows)
        at, out = np.arange(rows.num_rows), []
        for name in _columns(MERGED):
            if name == "status":
                out.append(pa.repeat(status, len(starts)))
                continue
            # the last one that is not null
            last = np.maximum.reduceat(np.where(rows[name].is_valid().to_numpy(), at, -1), starts)
            out.append(rows[name].take(pa.array(last, mask=last < 0)))
        yield pd.DataFrame({"rows": [closed(pa.table(out, names=_columns(MERGED)))]})

    def _wake(self, rows: pa.Table) -> None:
        wanted = pa.compute.min(rows["ts"]).as_py() + self.limit_ms
        timers = {t for t in self._handle.listTimers()}
        if wanted not in timers:
            for t in timers:
                self._handle.deleteTimer(t)
            self._handle.registerTimer(wanted)

    def _split(self, rows: pa.Table, starts: np.ndarray, out: np.ndarray) -> pa.Table:
        """Keep the transactions that are not ``out``; the rows of those that are."""
        goes = np.repeat(out, np.diff(np.append(starts, rows.num_rows)))
        left = rows.filter(pa.array(~goes))
        self._keep(left)
        if left.num_rows:
            self._wake(left)
        return rows.filter(pa.array(goes))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before, new = self._waiting(), rows_of(rows).select(_columns(RESULT))
        batch, starts, _ = self._ordered(new if before is None else pa.concat_tables([before, new]))
        told = batch["parts"].is_valid().to_numpy()
        parts = np.maximum.reduceat(np.where(told, batch["parts"].fill_null(0).to_numpy(), np.iinfo("int32").min), starts)
        size = np.diff(np.append(starts, batch.num_rows))
        complete = self._known(batch, starts) & np.logical_or.reduceat(told, starts) & (size >= parts)
        yield from self._merged(self._split(batch, starts, complete), "complete")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        if waiting is None:
            return
        waiting, starts, _ = self._ordered(waiting)
        latest = expiredTimerInfo.getExpiryTimeInMs() - self.limit_ms
        ts = np.minimum.reduceat(waiting["ts"].fill_null(np.iinfo("int64").max).to_numpy(), starts)
        due = self._known(waiting, starts) & (ts <= latest)
        yield from self._merged(self._split(waiting, starts, due), "timeout")

    def close(self) -> None:
        pass


def merged_stream(results: DataFrame, limit_ms: int = TIMEOUT_MS, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Results put together (MERGED): complete, or what there was ``limit_ms`` after the transaction's time, once the log has moved on by
    ``delay`` more."""
    # a pack is as late as its newest row
    packs = packed(results, F.pmod(F.xxhash64("type", "txn"), F.lit(buckets)), at="ts")
    packs = packs.withColumn("at", F.timestamp_millis("at")).withWatermark("at", delay)
    return unpacked(
        packs.groupBy("key").transformWithStateInPandas(WaitForAll(limit_ms), PACKED, outputMode="Append", timeMode="EventTime"), MERGED
    )


# ---- views -------------------------------------------------------------------------------------


class FirstCopies(StatefulProcessor):
    """Lets a row pass whose key has not come within the time to live. Keys are kept as pairs of 64-bit hashes, those of
    one micro-batch together, and each such block is forgotten by its own time to live."""

    def __init__(self, remembered_ms: int, columns: list[str]):
        self.remembered_ms = remembered_ms
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "block bigint", "hashes binary", ttlDurationMs=self.remembered_ms)
        self._blocks = handle.getValueState("blocks", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = rows_of(rows)
        pairs = np.stack([batch[n].to_numpy() for n in ("h1", "h2")])
        order = np.argsort(pairs[0], kind="stable")
        pairs = pairs[:, order]
        new = ~pd.DataFrame({"h1": pairs[0], "h2": pairs[1]}).duplicated().to_numpy()
        # what is known is looked up, not put together with the new
        for _, v in self._seen.iterator():
            known = ints(v[0], 2)
            at = np.searchsorted(known[0], pairs[0])
            same = np.flatnonzero(at < known.shape[1])
            same = same[known[0, at[same]] == pairs[0, same]]
            if len(same):
                known = known[:, np.isin(known[0], pairs[0, same])]
                new[same[pd.MultiIndex.from_arrays([*pairs[:, same]]).isin(pd.MultiIndex.from_arrays([*known]))]] = False
        if new.any():
            n = (self._blocks.get()[0] if self._blocks.exists() else 0) + 1
            self._blocks.update((n,))
            self._seen.updateValue((n,), (kept(pairs[:, new]),))
            first = np.zeros(len(order), dtype=bool)
            first[order[new]] = True
            yield pd.DataFrame({"rows": [closed(batch.select(self.columns).filter(pa.array(first)))]})

    def close(self) -> None:
        pass


def first_copies(log: DataFrame, keys: list[str], remembered_ms: int = REMEMBERED_MS, buckets: int = BUCKETS) -> DataFrame:
    """The log without the repeats of a key within ``remembered_ms`` of its first copy, by the clock: state stays
    as large as what comes in that time. First copies pass however late they are. To run it up to the end of the log only
    (``start_log``), turn batches without data off (``once``): a clock always gives another one."""
    hashed = log.withColumn("h1", F.xxhash64(*keys)).withColumn("h2", F.xxhash64(F.lit("second"), *keys))
    told = packed(hashed, F.pmod("h1", F.lit(buckets))).groupBy("key").transformWithStateInPandas(
        FirstCopies(remembered_ms, log.columns), PACKED, outputMode="Append", timeMode="ProcessingTime"
    )
    return unpacked(told, log.schema)


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """Queries started within stop when there are no more data, also where they live by the clock."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def customer_events(log: DataFrame) -> DataFrame:
    """Orders, deliveries and payments of customers from the modification log, for ``pipelines.customer_view``."""
    change = F.when(F.col("type") == "payment", -P.cents(F.col("amount"))).when(F.col("type") == "delivery", P.cents(F.col("amount")))
    kind = F.when(F.col("type") == "neworder", 0).when(F.col("type") == "delivery", 1).otherwise(PAYMENT)
    return log.where("type in ('neworder', 'delivery', 'payment')").select(
        "w", "d", "c", kind.alias("kind"), "ts", "txn", "order_id", "carrier", change.alias("change")
    )


# ---- stock level ---------------------------------------------------------------------------------

WANTED = "w int, d int, item bigint, wanted boolean"
LOW = "w int, d int, change int"


class WantedItems(StatefulProcessor):
    """Items of a district's newest orders: tells which come in and which go out.

    State: the newest orders, and the items of those and of orders not yet heard of. A line older than the oldest of a full
    list can only be of an order that is out.
    """

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("recent", "orders binary, lines binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        placed, lines = (ints(b, 3) for b in (self._state.get() if self._state.exists() else (None, None)))
        before = np.unique(lines[1, np.isin(lines[0], placed[1])])
        header = batch["order_id"].notna().to_numpy()

        def column(name: str, rows: np.ndarray) -> np.ndarray:
            return batch[name].to_numpy()[rows].astype("int64")

        placed = np.concatenate([placed, np.stack([column(c, header) for c in ("order_id", "txn", "ts")])], axis=1)
        placed = distinct(placed)[:, -self.depth :]
        lines = np.concatenate([lines, np.stack([column(c, ~header) for c in ("txn", "item", "ts")])], axis=1)
        oldest = placed[2].min() if placed.shape[1] == self.depth else lines[2].min(initial=0)
        lines = distinct(lines[:, np.isin(lines[0], placed[1]) | (lines[2] >= oldest)])
        self._state.update((kept(placed), kept(lines)))
        after = np.unique(lines[1, np.isin(lines[0], placed[1])])
        come, gone = np.setdiff1d(after, before), np.setdiff1d(before, after)
        item = np.concatenate([come, gone])
        out = pd.DataFrame({"item": item, "wanted": np.arange(len(item)) < len(come)})
        yield out.assign(w=key[0], d=key[1])[_columns(WANTED)]

    def close(self) -> None:
        pass


class LowStock(StatefulProcessor):
    """Levels of a shelf and the districts that want its items: tells by how much each one's count of items below its
    threshold changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("shelf", "levels binary, wanted binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        levels, wanted = (ints(b, n) for b, n in zip(self._state.get() if self._state.exists() else (None, None), (5, 3)))
        before = self._low(levels, wanted)
        told = batch["level"].notna().to_numpy()

        def columns(rows: np.ndarray, *names: str) -> np.ndarray:
            return np.stack([batch[n].to_numpy()[rows].astype("int64") for n in names])

        # the newest level of each item
        levels = np.concatenate([levels, columns(told, "item", "ts", "txn", "line", "level")], axis=1)
        levels = levels[:, np.lexsort(levels[3::-1])]
        levels = levels[:, np.append(levels[0, 1:] != levels[0, :-1], True)[: levels.shape[1]]]
        news = batch[~told]
        for now, part in news.groupby(news["wanted"].astype(bool)):
            pairs = np.stack([part[n].to_numpy().astype("int64") for n in ("d", "item", "threshold")])
            if now:
                wanted = distinct(np.concatenate([wanted, pairs], axis=1))
            else:
                out = pd.MultiIndex.from_arrays(wanted[:2]).isin(pd.MultiIndex.from_arrays(pairs[:2]))
                wanted = wanted[:, ~out]
        self._state.update((kept(levels), kept(wanted)))
        change = self._low(levels, wanted).sub(before, fill_value=0)
        change = change[change != 0]
        yield pd.DataFrame({"w": key[0], "d": change.index.astype("int32"), "change": change.to_numpy().astype("int32")})[_columns(LOW)]

    @staticmethod
    def _low(levels: np.ndarray, wanted: np.ndarray) -> pd.Series:
        at = np.searchsorted(levels[0], wanted[1])
        known = at < levels.shape[1]
        known[known] = levels[0, at[known]] == wanted[1, known]
        low = np.zeros(len(at), dtype=bool)
        low[known] = levels[4, at[known]] < wanted[2, known]
        return pd.Series(wanted[0, low]).value_counts()

    def close(self) -> None:
        pass


def stock_level_stream(orders_log: DataFrame, stock_log: DataFrame, threshold: Column, depth: int = 20) -> DataFrame:
    """Changes (LOW) of the number of items of each district's newest ``depth`` orders whose stock is below ``threshold`` (of w, d): the
    sum of a district's changes is its answer. Both arguments are the modification log, read once for each operator; repeats of rows change nothing."""
    told = orders_log.where("type in ('neworder', 'neworder-line')").select("w", "d", "txn", "ts", "order_id", "item")
    wanted = packed(told, F.col("w"), F.col("d")).groupBy("key").transformWithStateInPandas(
        Packed(WantedItems(depth), ["w", "d"]), WANTED, outputMode="Append", timeMode="None"
    )
    wanted = wanted.withColumn("threshold", threshold)
    levels = modifications.stock_writes(stock_log).withColumnRenamed("stock_w", "w")
    shelves = levels.unionByName(wanted, allowMissingColumns=True).withColumn("slot", F.floor(F.col("item") / SHELF))
    return packed(shelves, F.col("w"), F.col("slot")).groupBy("key").transformWithStateInPandas(
        Packed(LowStock(), ["w", "slot"]), LOW, outputMode="Append", timeMode="None"
    )
