"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 4, 5 and 6 bytes (A-Z lower-cased) that a text has, hashed to 2^20 slots.
From the labelled rows come, for each slot, the smoothed log ratio between the shares of toxic and of
clean texts that have it. Slots whose ratio stands out from chance are kept, at most MAX_FEATURES of
them; a text's features are the ratios of the kept slots it has, and logistic regression on them gives the
score. Counting and regression read at most MAX_ROWS labelled texts, so the model's size does not grow
with the input. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import sums
from tillroll.llm.text import _MASK, eight, lay, octets, packs
from tillroll.session import settle

SIZES = (4, 5, 6)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Labelled rows the classifier is fitted on: those with the smallest hashes of their ids.
MAX_ROWS = 20_000
MAX_FEATURES = 4_096
#: How many standard errors a log ratio must be from 0.
STANDS_OUT = 3.0
#: Added to each class's count of texts with a slot.
SMOOTHING = 0.5
#: Strength of the penalty on squared weights.
PENALTY = 1.0
THRESHOLD = 0.7
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slots(texts: list[bytes], keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct slots) for every text; only slots with keep[slot], if given."""
    buf, bounds = lay(texts)
    view = eight(buf)
    ends = np.repeat(bounds[1:] - 1, np.diff(bounds))
    at = np.arange(bounds[-1])
    owners, found = [], []
    for size in SIZES:
        slot = (((view[: len(at)] & _MASK[size]) * np.uint64(2 * size + 1)) * _ODD) >> np.uint64(64 - SLOT_BITS)
        whole = at + size <= ends
        if keep is not None:
            whole &= keep[slot]
        i = np.flatnonzero(whole)
        owners.append(np.searchsorted(bounds, i, side="right") - 1)
        found.append(slot[i])
    owner, slot = np.concatenate(owners), np.concatenate(found)
    key = np.unique((owner.astype(np.uint64) << np.uint64(SLOT_BITS)) | slot)
    owner, slot = (key >> np.uint64(SLOT_BITS)).astype(np.int64), (key & np.uint64(SLOTS - 1)).astype(np.int64)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        yield i, slot[cut[i] : cut[i + 1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each slot, and all texts in the last entry, of each class: toxic after clean."""
    counts = np.zeros((2, SLOTS + sums.SEGMENTS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for first, pack in packs(octets(batch.column("text"))):
            for i, slots in _slots(pack):
                counts[toxic[first + i], slots] += 1
                counts[toxic[first + i], -1] += 1
    ids, parts = sums.segments(counts.reshape(-1))
    yield pa.RecordBatch.from_pydict({"segment": pa.array(ids, pa.int32()), "counts": pa.array(parts, pa.binary())})


def _kept_slots(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.cumsum(keep.value) - 1
        for batch in batches:
            out = []
            for _, pack in packs(octets(batch.column("text"))):
                out += [order[s].astype("<i2").tobytes() for _, s in _slots(pack, keep.value)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "kept": pa.array(out, pa.binary())})

    return run


@dataclass
class Model:
    """``weights`` by slot, the naive Bayes scaling included, and the intercept."""

    keep: np.ndarray
    weights: np.ndarray
    bias: float


def _regression(rows: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    value = scale[col]
    n = len(rows)
    share = (toxic.sum() + SMOOTHING) / (n + 2 * SMOOTHING)
    start = np.log(share / (1 - share))
    w, b = np.zeros(len(scale)), start
    squares = np.bincount(owner, value**2, minlength=n)
    step = 1 / (0.25 * (squares.max(initial=0) + 1) * n + PENALTY)
    # a bound on the curvature: the largest eigenvalue, by a few power steps
    v = np.random.default_rng(0).random(len(scale) + 1)
    for _ in range(20 if len(col) else 0):
        z = np.bincount(owner, value * v[col], minlength=n) + v[-1]
        v = np.append(np.bincount(col, value * z[owner], minlength=len(scale)), z.sum())
        size = np.linalg.norm(v)
        v = v / size
    if len(col):
        step = 1 / (0.25 * 1.2 * size + PENALTY)
    w0, b0, t = w, b, 1.0
    for _ in range(400):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * yw[col], minlength=n) + yb, -60, 60))) - toxic
        w0, b0, t = w, b, t1
        w = yw - step * (np.bincount(col, value * p[owner], minlength=len(scale)) + PENALTY * yw)
        b = yb - step * p.sum()
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1; others are left out).

    An id counts once, with its largest label and its smallest text. With more than ``max_rows`` ids,
    those with the smallest hashes are used. Without any, every score is 1/2; with one class only, near
    that class's share.
    """
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = settle(one)
    total = one.count()
    if total > max_rows:
        # by hash, not by limit: the same rows each time, with no sort
        share = int(max_rows / total * (1 << 31))
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)
    # about max_rows ids at most, so this side has a known bound
    usable = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
    usable = usable.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    usable = settle(usable)
    counts = sums.total(usable.mapInArrow(_count, sums.SCHEMA), 2 * (SLOTS + sums.SEGMENTS)).reshape(2, -1)
    with_slot, texts = counts[:, :SLOTS], counts[:, -1:]
    clean, toxic = with_slot + SMOOTHING
    ratio = np.log(toxic / (texts[1] + 2 * SMOOTHING)) - np.log(clean / (texts[0] + 2 * SMOOTHING))
    error = np.sqrt(1 / clean + 1 / toxic)
    clear = np.where(with_slot.sum(axis=0) > 0, np.abs(ratio) / error, 0)
    keep = clear >= STANDS_OUT
    if keep.sum() > MAX_FEATURES:
        keep = np.zeros(SLOTS, dtype=bool)
        keep[np.argsort(-clear, kind="stable")[:MAX_FEATURES]] = True
    shared = spark.sparkContext.broadcast(keep)
    rows = usable.select("text", "toxic").mapInArrow(_kept_slots(shared), "toxic int, kept binary").collect()
    scale = ratio[keep]
    w, b = _regression(
        [np.frombuffer(r["kept"], dtype="<i2").astype(np.int64) for r in rows], np.array([r["toxic"] for r in rows], float), scale
    )
    weights = np.zeros(SLOTS)
    weights[keep] = w * scale
    return Model(keep, weights, b)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = []
            for _, pack in packs(octets(batch.column("text"))):
                scores += [m.bias + m.weights[s].sum() for _, s in _slots(pack, m.keep)]
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, dtype=float), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score)],
                names=[*(c for c in batch.schema.names if c != "text"), "score"],
            )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Returns (doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels``: (doc_id, toxic). Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels
    are not learnt from. An id without label is only scored. Null and empty texts get the score of a text without features. A null doc_id is not held out
    and has no label. Other columns are ignored.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = spark.sparkContext.broadcast(fit(docs, marked))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _score(model), "doc_id bigint, held_out boolean, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic, with all their columns."""
    spark = docs.sparkSession
    marked = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = spark.sparkContext.broadcast(fit(docs, marked))
    row = F.struct(*docs.columns).alias("row")
    scored = docs.select(row, "text").mapInArrow(
        _score(model), f"row {docs.schema.simpleString()}, score double"
    )
    return scored.where(F.col("score") < threshold).select("row.*")
