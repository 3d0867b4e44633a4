"""Benchmark decontamination over a distributed positional inverted index.

Documents are indexed in blocks of a bounded number of bytes: a block lays its texts end to end with a
gap between them, and stores for each of its words the ascending places of it, delta-coded, and for each
document where it starts. The index is a table and can be kept for other test sets.

A phrase is looked up from its rarest word: words are counted over the whole index, a phrase with a word
that no document has is dropped, and only blocks with its rarest word are opened. There the places of
the rarest word, less the word's offset in the phrase, are intersected with those of the next rarest, and
so on, so the candidates shrink fastest first. With ``slop`` words may also stand that far from
their offset (proximity matches).

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import ALNUM, fold, octets, signed, words
from tillroll.session import settle

BLOCK_BYTES = 4 << 20
WINDOW = 13
#: Free places between two documents of a block; larger than any slop.
GAP = 64

INDEX = "block bigint, term bigint, n bigint, places binary, doc_id bigint, first bigint, n_words bigint"


def _postings(block: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    h, at = words(texts, ALNUM)
    counts = np.diff(at)
    firsts = at[:-1] + GAP * np.arange(len(texts))
    places = np.arange(len(h)) + np.repeat(GAP * np.arange(len(texts)), counts)
    order = np.argsort(h, kind="stable")
    h, places = h[order], places[order]
    starts = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1))) if len(h) else np.empty(0, dtype=np.int64)
    steps = np.diff(places, prepend=0)
    steps[starts] = places[starts]  # each list starts anew
    n = np.diff(np.append(starts, len(h)))
    data = pa.py_buffer(steps.astype("<i4").tobytes())
    bounds = pa.py_buffer((4 * np.append(starts, len(h))).astype("<i4").tobytes())
    k = len(starts)
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(np.full(k, block)), "term": pa.array(signed(h[starts])), "n": pa.array(n),
        "places": pa.Array.from_buffers(pa.binary(), k, [None, bounds, data]),
        "doc_id": pa.nulls(k, pa.int64()), "first": pa.nulls(k, pa.int64()), "n_words": pa.nulls(k, pa.int64()),
    })
    m = len(texts)
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(np.full(m, block)), "term": pa.nulls(m, pa.int64()), "n": pa.nulls(m, pa.int64()),
        "places": pa.nulls(m, pa.binary()), "doc_id": pa.array(ids, pa.int64()), "first": pa.array(firsts),
        "n_words": pa.array(counts),
    })


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), octets(batch.column("text"))):
                t = t or b""
                if texts and size + len(t) > block_bytes:
                    yield from _postings(block, ids, texts)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield from _postings(block, ids, texts)

    return run


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positional index of all texts of ``docs`` (doc_id bigint, text), written to the shared folder.

    Rows with a term are postings; rows without one are documents. Words are runs of digits, letters
    a-z after lower-casing A-Z, and non-ASCII characters; null has none. A document never spans
    two blocks, one longer than ``block_bytes`` is a block of its own.
    """
    return settle(docs.select("doc_id", "text").mapInArrow(_blocks(block_bytes), INDEX))


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = words([t or b"" for t in octets(batch.column("text"))], ALNUM)
            out = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if b > a:
                    for i in range(a, max(a, b - size) + 1):
                        part = h[i : min(i + size, b)]
                        out.append((int(fold(part).view(np.int64)), item, signed(part).tolist()))
            wid, items, terms = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "wid": pa.array(wid, pa.int64()), "item_id": pa.array(items, pa.string()),
                "terms": pa.array(terms, pa.list_(pa.int64())),
            })

    return run


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(wid, item_id string, terms): every run of ``size`` words of each item, or the whole item if it
    has fewer. Equal runs have one wid. Items without words have none."""
    source = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return source.mapInArrow(_windows(size), "wid bigint, item_id string, terms array<bigint>")


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, dtype="<i4").astype(np.int64))


def _intersect(slop: int):
    def near(found: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places wanted have one within the slop, and which have it exactly."""
        i = np.searchsorted(places, found - slop)
        at = places[np.minimum(i, len(places) - 1)]
        j = np.searchsorted(places, found)
        same = (j < len(places)) & (places[np.minimum(j, len(places) - 1)] == found)
        return (i < len(places)) & (np.abs(at - found) <= slop), same

    def run(key, postings: pa.Table, asked: pa.Table) -> pa.Table:
        lists = dict(zip(postings.column("term").to_pylist(), postings.column("places").to_pylist()))
        lists.pop(None, None)
        firsts = np.sort(postings.column("first").drop_null().to_numpy())
        opened: dict[int, np.ndarray] = {}
        wids, starts, sizes, exacts = [], [], [], []
        for wid, steps in zip(asked.column("wid").to_pylist(), asked.column("steps").to_pylist()):
            if any(s["term"] not in lists for s in steps):
                continue
            found = exact = None
            for s in steps:
                if s["term"] not in opened:
                    opened[s["term"]] = _places(lists[s["term"]])
                places = opened[s["term"]]
                if found is None:
                    found = places - s["off"]
                    exact = np.ones(len(found), dtype=bool)
                else:
                    ok, same = near(found + s["off"], places)
                    found, exact = found[ok], (exact & same)[ok]
                if not len(found):
                    break
            wids.append(np.full(len(found), wid))
            starts.append(found)
            sizes.append(np.full(len(found), len(steps)))
            exacts.append(exact)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, dtype=kind)
        start = join(starts, np.int64)
        first = firsts[np.searchsorted(firsts, start, side="right") - 1] if len(start) else start
        return pa.table({
            "block": pa.array(np.full(len(start), key[0].as_py(), dtype=np.int64)), "first": pa.array(first), "wid": pa.array(join(wids, np.int64)),
            "start": pa.array(start), "size": pa.array(join(sizes, np.int64)),
            "exact": pa.array(join(exacts, bool)),
        })

    return run


def find(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """(block, first, wid, start, size, exact): where the windows of ``wanted`` stand, as places in
    the index's blocks; ``first`` is the place where the document starts.

    With ``slop`` 0 only exact phrases; else also places where each word is within ``slop`` of its offset
    from the rarest one (``exact`` tells them apart).
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    distinct = wanted.select("wid", "terms").dropDuplicates(["wid"])
    terms = distinct.select("wid", F.posexplode("terms").alias("off", "term"))
    postings = index.where("term is not null").select("block", "term", "n", "places")
    used = settle(postings.join(terms.select("term").distinct(), "term", "left_semi"))
    counts = used.groupBy("term").agg(F.sum("n").alias("freq"))
    plans = (
        terms.join(counts, "term", "left").groupBy("wid")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "off", "term"))).alias("steps"))
        .where(F.col("steps")[0]["freq"].isNotNull())  # null sorts first: a word that is nowhere
    )
    seeds = plans.withColumn("term", F.col("steps")[0]["term"])
    asked = settle(used.select("block", "term").join(seeds, "term").select(F.col("block").alias("at"), "wid", "steps"))
    starts = index.where("term is null").select("block", "first").join(asked, F.col("block") == F.col("at"), "left_semi")
    opened = used.select("block", "term", "places").unionByName(starts, allowMissingColumns=True)
    return opened.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(
        _intersect(slop), "block bigint, first bigint, wid bigint, start bigint, size bigint, exact boolean"
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if it lies inside any occurrence of a window of ``items`` (item_id, text; see ``windows``);
    n_items counts the items with occurring windows; items_sha256 is the digest of their ids as strings,
    sorted and comma-joined. Contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have
    no words and are clean; null item ids count in hits, not among the items. Rows that repeat an id are
    judged one by one. Without items nothing is hit; without documents there are no rows.
    """
    index = build_index(docs)
    asked = settle(windows(items, size))
    found = find(index, asked)
    directory = index.where("term is null").select("block", "doc_id", "first", "n_words")
    inside = settle(found.withColumn("end", F.col("start") + F.col("size")).drop("size", "exact"))
    w = Window.partitionBy("block", "first").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gained = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start"))))
    hits = inside.withColumn("gain", gained).groupBy("block", "first").agg(F.sum("gain").alias("n_hit"))
    named = (
        inside.select("block", "first", "wid").distinct()
        .join(asked.select("wid", "item_id").distinct(), "wid")
        .groupBy("block", "first").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    out = (
        directory.join(hits, ["block", "first"], "left").join(named, ["block", "first"], "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Every row is judged by its
    own text, known by a hash of id and text: rows that share an id, or have none, have their own verdicts."""
    own = F.xxhash64("doc_id", "text")
    bad = contamination(docs.select(own.alias("doc_id"), "text"), items).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("own")).distinct()
    return docs.select(F.struct("*").alias("row"), own.alias("own")).join(bad, "own", "left_anti").select("row.*")
