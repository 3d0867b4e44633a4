"""Documents whose word-shingle sets have at least a given Jaccard similarity, by prefix filtering.

Method. A set's shingles are put in one global order, rare ones first. Two sets that reach the
threshold share a shingle within their *prefixes*, the first ``n - ceil(t n) + 1`` shingles, so
documents meet only at prefix shingles. Of those that meet, the length filter (sizes within
t), the positional filter (what can still follow the shared shingle) and the suffix filter (a lower
bound on the difference, from counts by hash range, a few bytes a set) remove what cannot reach t; each remaining pair
is verified once, on the texts' full sets.

Groups of copies do not become all their pairs. Equal sets are one node from the start. At each prefix
shingle every node is first paired with one hub, the node where the shingle stands earliest (in a
family of edited copies, that is the least edited one). Then only pairs whose two nodes
are not yet in one component are formed, each with one side outside the shingle's most frequent
component. A pair left out is one whose nodes are connected already, so components are exact.

Prefix rows travel packed: those of many documents that go to one bucket of shingles are one compressed block, in which
each node stands once. Texts travel compressed, one for each node of a pair to verify.

Rarity comes from counts in 2^20 hashed slots over all documents. Slots shared by chance add nearly the
same to every count; the order only has to be the same everywhere for results to be right. Shingles
are compared by 64-bit hashes, equal sets by a 64-bit digest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import graph, sums
from tillroll.llm.text import PACK_BYTES, mix, octets, packs, shingle_sets, signed
from tillroll.session import settle

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Nodes at one prefix shingle above which they are dealt over several hubs.
HOT = 50_000
SUFFIX_PARTS = 64
#: Prefix rows of a bucket of shingles, about; and rows a task packs at a time.
BUCKET_ROWS = 400_000
PACKED_ROWS = 1_000_000
_ZSTD = pa.Codec("zstd")


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def slots_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _profile(size: int):
    """Per document its set's size and node, and the compressed text where the node is new to the task; per task the
    slot counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        seen: set[int] = set()
        for batch in batches:
            n, nodes, texts, parts = [], [], [], []
            for _, pack in packs(octets(batch.column("text"))):
                sets = shingle_sets(pack, size)
                n += [len(s) for s in sets]
                for s, text in zip(sets, pack):
                    node = node_of(s) if len(s) else None
                    nodes.append(node)
                    new = node is not None and node not in seen
                    texts.append(squeeze(text) if new else None)
                    parts.append(part_counts(s) if new else None)
                    seen.add(node)
                counts += np.bincount(slots_of(np.concatenate(sets)), minlength=SLOTS)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                "node": pa.array(nodes, pa.int64()), "packed": pa.array(texts, pa.binary()), "parts": pa.array(parts, pa.binary()), "segment": pa.nulls(len(n), pa.int32()),
                "counts": pa.nulls(len(n), pa.binary()),
            })
        ids, parts = sums.segments(counts)
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": none, "n": none, "node": none, "packed": pa.nulls(len(ids), pa.binary()), "parts": pa.nulls(len(ids), pa.binary()),
            "segment": pa.array(ids, pa.int32()), "counts": pa.array(parts, pa.binary()),
        })

    return run


PROFILE = "doc_id bigint, n bigint, node bigint, packed binary, parts binary, segment int, counts binary"


def part_counts(s: np.ndarray) -> bytes:
    """A set's shingles by hash range, a byte each: counts from 255 on are 255, which brings no two sets further apart."""
    return np.minimum(np.bincount((s >> np.uint64(64 - 6)).astype(np.int64), minlength=SUFFIX_PARTS), 255).astype(np.uint8).tobytes()


def _near_enough(num: int, den: int):
    """The pairs whose counts by hash range allow num/den: |a ^ b| is at least what the counts differ by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SUFFIX_PARTS).astype(np.int64) for c in ("parts_a", "parts_b"))
            apart = np.abs(a - b).sum(axis=1)
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array((den + num) * (total - apart) >= 2 * num * total)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("a", "b")})

    return run


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: what is alike stands together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _block(token: np.ndarray, deal: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> bytes:
    """Rows sorted by token as one compressed block."""
    nodes, first, which = np.unique(node, return_index=True, return_inverse=True)
    step = np.diff(token, prepend=np.uint64(0))
    columns = [
        step.astype("<u8"), deal.astype("<i4"), which.astype("<i4"), at.astype("<i4"), nodes.astype("<i8"), n[first].astype("<i8"),
    ]
    return len(token).to_bytes(8, "little") + squeeze(b"".join(_planes(c) for c in columns))


def _rows(block: bytes) -> tuple[np.ndarray, ...]:
    """token, deal, node, n and place of a block's rows."""
    size, data = int.from_bytes(block[:8], "little"), unsqueeze(block[8:])
    step, deal, which, at = (_numbers(data[a * size : b * size], k) for a, b, k in ((0, 8, "<u8"), (8, 12, "<i4"), (12, 16, "<i4"), (16, 20, "<i4")))
    rest = data[20 * size :]
    nodes, n = _numbers(rest[: len(rest) // 2], "<i8"), _numbers(rest[len(rest) // 2 :], "<i8")
    return np.cumsum(step), deal.astype(np.int64), nodes[which], n[which], at.astype(np.int64)


def _prefixes(size: int, num: int, den: int, shared, hot: int, buckets: int):
    """The prefix shingles of each set, in blocks by bucket: shingle, deal (the hub group of hot shingles), node, set size and
    place. Equal sets of one task come once."""

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        token, deal, node, n, at = (np.concatenate(c) for c in zip(*held))
        bucket = (mix(token ^ (deal.astype(np.uint64) << np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((token, bucket))
        bucket = bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            out.append(_block(token[rows], deal[rows], node[rows], n[rows], at[rows]))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]].astype(np.int32)), "rows": pa.array(out, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        usual = counts.mean()
        seen: set[int] = set()
        held, rows = [], 0
        for batch in batches:
            for _, pack in packs(octets(batch.column("text"))):
                for s in shingle_sets(pack, size):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    count = counts[slots_of(s)]
                    rare_first = np.argsort(count, kind="stable")[: n - (num * n + den - 1) // den + 1]
                    deals = (np.maximum(count[rare_first] - usual - 6 * usual**0.5, 0) // hot).astype(np.int64)
                    deal = np.where(deals > 0, np.abs(node) % (deals + 1) + 1, 0)
                    held.append((s[rare_first], deal, np.full(len(deal), node), np.full(len(deal), n), np.arange(len(deal))))
                    rows += len(deal)
                if rows > PACKED_ROWS:
                    yield blocks(held)
                    held, rows = [], 0
        if held:
            yield blocks(held)

    return run


MET = "token bigint, node bigint, n bigint, i bigint, hub bigint"


def _meet(num: int, den: int):
    """Of one bucket the rows of shingles that several nodes have: with the shingle's hub, where that can match."""

    def run(table: pa.Table) -> pa.Table:
        token, deal, node, n, i = (np.concatenate(c) for c in zip(*(_rows(b) for b in table.column("rows").to_pylist())))
        order = np.lexsort((node, i, deal, token))
        token, deal, node, n, i = (c[order] for c in (token, deal, node, n, i))
        # a node that came from several tasks counts once
        again = np.concatenate([[False], (token[1:] == token[:-1]) & (deal[1:] == deal[:-1]) & (i[1:] == i[:-1]) & (node[1:] == node[:-1])])
        token, deal, node, n, i = (c[~again] for c in (token, deal, node, n, i))
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (deal[1:] != deal[:-1])]))
        size = np.diff(np.append(first, len(token)))
        hub = np.repeat(first, size)
        keep = np.flatnonzero((np.repeat(size, size) > 1) | (deal > 0))
        token, node, n, i, hub, hub_n, hub_i = token[keep], node[keep], n[keep], i[keep], node[hub[keep]], n[hub[keep]], i[hub[keep]]
        needed = -(-(n + hub_n) * num // (num + den))
        match = (np.minimum(n, hub_n) * den >= np.maximum(n, hub_n) * num) & (1 + np.minimum(n - i - 1, hub_n - hub_i - 1) >= needed)
        match &= node != hub
        return pa.table({
            "token": pa.array(signed(token)), "node": pa.array(node), "n": pa.array(n), "i": pa.array(i), "hub": pa.array(hub, mask=~match),
        })

    return run


def overlap_needed(na: Column, nb: Column, num: int, den: int) -> Column:
    """The least intersection with which two sets of these sizes reach num/den."""
    return F.ceil(((na + nb) * num).cast("double") / (num + den) - 1e-9)


def _can_match(na, ia, nb, ib, num, den) -> Column:
    """Length filter, and positional filter for a shingle at places ia and ib (from 0)."""
    near = (F.least(na, nb) * den >= F.greatest(na, nb) * num)
    return near & (1 + F.least(na - ia - 1, nb - ib - 1) >= overlap_needed(na, nb, num, den))


def reaches(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets reach num/den: suffix filter, then the count itself."""
    top = np.uint64(64 - 6)
    apart = np.abs(
        np.bincount((a >> top).astype(np.int64), minlength=SUFFIX_PARTS)
        - np.bincount((b >> top).astype(np.int64), minlength=SUFFIX_PARTS)
    ).sum()
    total = len(a) + len(b)
    # |a & b| = (total - |a ^ b|) / 2, and |a ^ b| is at least ``apart``
    if (den + num) * (total - apart) < 2 * num * total:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (total - both)


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            # a few pairs at a time, by their size compressed
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            for first, pack in packs(a, PACK_BYTES // 4):
                others = b[first : first + len(pack)]
                sets = zip(*(shingle_sets([unsqueeze(x) for x in side], size) for side in (pack, others)))
                keep += [reaches(x, y, num, den) for x, y in sets]
            yield pa.RecordBatch.from_pydict({
                "a": batch.column("a").filter(pa.array(keep, pa.bool_())),
                "b": batch.column("b").filter(pa.array(keep, pa.bool_())),
            })

    return run


def jaccard_components(
    docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, hot: int = HOT
) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id bigint, text).

    Two documents link when the sets of their ``size``-word shingles have a Jaccard similarity of at
    least ``num/den``; component_id is the smallest doc_id reachable by links, itself included.
    Words are runs of anything but space and tab to carriage return, A-Z lower-cased; a text of fewer
    words is one shingle. Null and empty texts, and texts of white space, have no shingles and link with
    nothing. Rows of one doc_id count as one document when links are followed. A row whose doc_id is
    null keeps its n_shingles and takes its copies' component if one of them has an id, else null.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    profile = settle(source.mapInArrow(_profile(size), PROFILE))
    known = profile.where("segment is null").select("doc_id", "n", "node")
    counts = sums.total(profile.where("segment is not null"), SLOTS)
    shared = spark.sparkContext.broadcast(counts)  # 2^20 numbers, whatever the input

    rows = known.agg(F.sum(F.col("n") * (den - num) / den + 1)).first()[0] or 0
    buckets = max(1, -(-int(rows) // BUCKET_ROWS))
    prefix = source.select("text").mapInArrow(_prefixes(size, num, den, shared, hot, buckets), "bucket int, rows binary")
    met = settle(prefix.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(num, den), MET))

    shapes = profile.where("packed is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("parts").alias("parts"))
    shapes = settle(shapes.select("node", "n", "parts"))

    def linked(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(shapes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("parts").alias(f"parts_{side}")), side)
        pairs = settle(pairs.mapInArrow(_near_enough(num, den), "a bigint, b bigint"))
        # one text for each node of a pair; other texts stay where they are while the pairs are few
        nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        texts = profile.where("packed is not null").select("node", "packed").join(nodes, "node", "left_semi")
        texts = texts.groupBy("node").agg(F.first("packed").alias("packed"))
        left = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
        # dealt by node at every size: one plan, whose shuffles grow with the texts
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_verify(size, num, den), "a bigint, b bigint")

    def ends(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    c = F.col
    links = settle(linked(met.where("hub is not null").select(*ends("node", "hub")).distinct()))
    so_far = graph.components(links)

    # what stars leave: pairs at one shingle between different components
    placed = met.select("token", "node", "n", "i").join(so_far, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("components")
    )
    open_ = settle(placed.join(mixed.where("components > 1"), "token").drop("components"))
    few = open_.where("component <> main").select(
        "token", c("node").alias("a"), c("n").alias("na"), c("i").alias("ia"), c("component").alias("ca")
    )
    every = open_.select("token", c("node").alias("b"), c("n").alias("nb"), c("i").alias("ib"), c("component").alias("cb"))
    rest = few.join(every, "token").where("ca <> cb").where(_can_match(c("na"), c("ia"), c("nb"), c("ib"), num, den))
    more = linked(rest.select(*ends("a", "b")).distinct())
    groups = graph.components(links.unionByName(more))

    # nodes that share a doc_id are one document
    placed_docs = known.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed_docs.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return placed_docs.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: that with the smallest id (null
    last), then the smallest hash of its text, then the smallest row as JSON.

    Every row is judged by its own text, so rows that share an id, or have none, go only if another row of
    their component stays. Rows without words stay. Any names of other columns will do.
    """
    key = F.xxhash64("text")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    groups = (
        jaccard_components(docs.select(key.alias("doc_id"), "text"), size, num, den).where("n_shingles > 0")
        .select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    )
    # each text's smallest id and how many rows have both, before anything is joined
    ids = docs.where(~wordless).groupBy(key.alias("key"), F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "rows").alias("first")
    least = ids.select("key", first).groupBy("key").agg(F.min("first").alias("first"))
    stay = settle(least.join(groups, "key").groupBy("component").agg(F.min("first").alias("first")).select("first.*"))

    row = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("doc_id").alias("id"), wordless.alias("wordless"))

    def rows_of(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select(F.col("key").alias("its_key"), F.col("id").alias("its_id"))
        same = (F.col("key") == F.col("its_key")) & F.col("id").eqNullSafe(F.col("its_id"))
        return row.where(~F.col("wordless")).join(chosen, same, "left_semi")

    # only rows that agree in id and text have to be told apart
    repeated = rows_of(stay.where("rows > 1")).groupBy("key", "id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    out = rows_of(stay.where("rows = 1")).select("row").unionAll(repeated.select("row")).unionAll(row.where("wordless").select("row"))
    return out.select("row.*")
