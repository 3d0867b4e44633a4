"""Quality: labelled neighbours in a latent-semantic space vote, weighted by similarity.

A text's terms are its runs of three bytes, upper and lower case apart, hashed to SLOTS slots, and the repeats of a
word one to BACK words on, a slot for each distance. A slot weighs
(1 + log times) * log(texts / texts with it), the texts being all of the table. The latent-semantic
directions are the leading right singular vectors of the labelled texts' term matrix, found by subspace
iteration, each step a Spark job over the labelled rows. All texts are mapped to them and scaled to length
one. The labelled vectors, at most MAX_ROWS, are broadcast; each block of texts is multiplied with all of
them, exactly, and the NEIGHBOURS nearest vote with weights cosine ** SHARPNESS.

Only labels are learnt from a bounded sample; term counts come from every text, and every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import sums
from tillroll.llm.text import _MASK, NOT_SPACE, eight, hash_spans, octets, packs
from tillroll.session import settle

TERM = 3
SLOT_BITS = 13
SLOTS = 1 << SLOT_BITS
#: A word is compared with so many words before it.
BACK = 8
#: Slots of both kinds, a multiple of the segments of a sum.
WIDTH = SLOTS + sums.SEGMENTS
#: Labelled rows that vote: of each label, those with the smallest hashes of their ids.
MAX_ROWS = 8_192
DIMS = 32
#: Directions carried besides, so that the last of DIMS settle too.
SPARE = 8
STEPS = 4
#: Tasks of a step: so many sums of WIDTH * (DIMS + SPARE) floats come to the driver.
TASKS = 8
NEIGHBOURS = 25
SHARPNESS = 4
THRESHOLD = 0.5
#: Texts counted at a time: the table of their slots is WIDTH floats each.
TEXTS = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)


def term_counts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """How often each slot occurs in each text, a few texts at a time."""
    for i in range(0, len(texts), TEXTS):
        some = texts[i : i + TEXTS]
        buf = np.frombuffer(b"".join(some) + b" " * 8, dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in some), dtype=np.int64, count=len(some))
        total = int(sizes.sum())
        slot = (((eight(buf)[:total] & _MASK[TERM]) * _ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        owner = np.repeat(np.arange(len(some)), sizes)
        # the last two bytes of a text start no term
        whole = np.repeat(np.cumsum(sizes), sizes) - np.arange(total) >= TERM
        terms = [(owner * WIDTH + slot)[whole]]
        inside = np.append(NOT_SPACE[buf[:total]], [False])
        ends = np.cumsum(sizes)
        edges = inside.copy()
        edges[1:-1] &= inside[:-2]
        edges[np.append(0, ends[:-1])[sizes > 0]] = False  # a text starts a word
        starts = np.flatnonzero(inside & ~edges)
        last = inside[:-1] & ~edges[1:]
        stops = np.flatnonzero(last) + 1
        h, whose = hash_spans(buf, starts, stops - starts), owner[starts]
        for back in range(1, BACK + 1):
            again = (h[back:] == h[:-back]) & (whose[back:] == whose[:-back])
            terms.append(whose[back:][again] * WIDTH + SLOTS + back)
        yield np.bincount(np.concatenate(terms), minlength=len(some) * WIDTH).reshape(-1, WIDTH)


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each slot; all texts in the last segment's last place."""
    counts = np.zeros(WIDTH + sums.SEGMENTS, dtype=np.int64)
    for batch in batches:
        for _, pack in packs(octets(batch.column("text"))):
            for table in term_counts(pack):
                counts[:WIDTH] += (table > 0).sum(axis=0)
                counts[-1] += len(table)
    ids, parts = sums.segments(counts)
    yield pa.RecordBatch.from_pydict({"segment": pa.array(ids, pa.int32()), "counts": pa.array(parts, pa.binary())})


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one; a text without terms is zero."""
    out = np.zeros(table.shape, dtype=np.float32)
    some = table > 0
    out[some] = 1 + np.log(table[some])
    out *= idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _sparse(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for _, pack in packs(octets(batch.column("text"))):
                for table in term_counts(pack):
                    for row in weighted(table, idf):
                        at = np.flatnonzero(row)
                        slots.append(at.astype("<i2").tobytes())
                        values.append(row[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "label": batch.column("label"), "slots": pa.array(slots, pa.binary()), "vals": pa.array(values, pa.binary()),
            })

    return run


def _dense(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    slots, values = batch.column("slots").to_pylist(), batch.column("vals").to_pylist()
    for i in range(0, len(slots), TEXTS):
        out = np.zeros((min(TEXTS, len(slots) - i), WIDTH), dtype=np.float32)
        for j, row in enumerate(out):
            row[np.frombuffer(slots[i + j], dtype="<i2")] = np.frombuffer(values[i + j], dtype="<f4")
        yield out


def _gram(shared):
    """A task's part of X' X Q, for labelled rows X and directions Q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total = np.zeros(q.shape, dtype=np.float64)
        for batch in batches:
            for x in _dense(batch):
                total += x.T @ (x @ q)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    return run


def directions(rows: DataFrame) -> np.ndarray:
    """The leading right singular vectors (WIDTH x DIMS, float32) of ``rows`` (slots, vals)."""
    spark = rows.sparkSession
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((WIDTH, DIMS + SPARE)))[0].astype(np.float32)
    for step in range(STEPS):
        parts = rows.select("slots", "vals").mapInArrow(_gram(spark.sparkContext.broadcast(q)), "part binary").collect()
        z = sum((np.frombuffer(p["part"], dtype="<f4").astype(np.float64) for p in parts), np.zeros(q.size)).reshape(q.shape)
        if step < STEPS - 1:
            q = np.linalg.qr(z)[0].astype(np.float32)
    # Q' X' X Q is small: its eigenvectors turn Q onto the singular ones
    small = q.T.astype(np.float64) @ z
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return (q @ turn[:, ::-1][:, :DIMS]).astype(np.float32)


def latent(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows in the latent space, of length one or zero."""
    y = x @ v
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(norm > 1e-6, norm, np.inf)


def _map_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [r.astype("<f4").tobytes() for x in _dense(batch) for r in latent(x, shared.value)]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "vec": pa.array(vec, pa.binary())})

    return run


@dataclass
class Model:
    """Term weights, directions, and the labelled vectors with their labels; ``share`` is the score without neighbours."""

    idf: np.ndarray
    v: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Scores of texts from their term counts."""
        y = latent(weighted(table, self.idf), self.v)
        if not len(self.vectors):
            return np.full(len(y), self.share)
        cosine = y @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-12, np.clip(votes / np.where(total > 1e-12, total, 1), 0, 1), self.share)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1; others are left out).

    An id counts once, with its largest label and its smallest text. With more than ``max_rows`` ids, each label has at
    most half of them, or what the other leaves. Without labels every score is 1/2.
    """
    spark = docs.sparkSession
    with_slot = sums.total(docs.select("text").mapInArrow(_texts_with, sums.SCHEMA), WIDTH + sums.SEGMENTS)
    idf = np.log((with_slot[-1] + 1) / (with_slot[:WIDTH] + 1)).astype(np.float32)
    one = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    one = settle(one)
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    few = min(counts.get(0, 0), counts.get(1, 0), max_rows // 2)
    keep = {label: min(n, max(max_rows // 2, max_rows - few)) for label, n in counts.items()}
    wanted = F.lit(False)
    for label, n in counts.items():
        # by hash, not by limit: the same rows each time, with no sort
        part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(keep[label] / n * (1 << 31))
        wanted = wanted | ((F.col("label") == label) & (part if keep[label] < n else F.lit(True)))
    # about max_rows ids at most, so this side has a known bound
    chosen = F.broadcast(one.where(wanted))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.repartition(TASKS, "doc_id").mapInArrow(_sparse(idf), "label int, slots binary, vals binary")
    rows = settle(rows).coalesce(TASKS)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if not total:
        return Model(idf, np.zeros((WIDTH, DIMS), dtype=np.float32), np.zeros((0, DIMS), dtype=np.float32), np.zeros(0), share)
    v = directions(rows)
    voters = rows.mapInArrow(_map_rows(spark.sparkContext.broadcast(v)), "label int, vec binary").collect()
    vectors = np.frombuffer(b"".join(r["vec"] for r in voters), dtype="<f4").reshape(-1, DIMS)
    some = np.abs(vectors).sum(axis=1) > 0
    return Model(idf, v, vectors[some], np.array([r["label"] for r in voters], dtype=np.float64)[some], share)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.scores(table) for _, pack in packs(octets(batch.column("text"))) for table in term_counts(pack)]
            names = [c for c in batch.schema.names if c != "text"]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Returns (doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels``: (doc_id, quality 0 or 1). Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are not
    learnt from. A text that shares no direction with a labelled one (null, empty, under three bytes) gets the share of
    label 1. A null doc_id is not held out and has no label. Repeated rows get equal scores. Other columns are ignored; an empty table gives no rows.
    """
    marked = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, marked, max_rows))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
