"""Passages repeated across documents, by a sparse suffix array sorted deep-shallow.

A byte goes if a ``WINDOW``-byte string over it also starts in a document with a smaller id. Not
every suffix is needed to find such strings: each window is represented by its *anchor*, the place in it whose
KMER bytes hash lowest (the leftmost of equals). Equal windows have equal anchors, at the same
distance from the start. So only suffixes at anchors are sorted, and of those only the ones whose
KMER bytes stand in more than one document.

Steps:
0. Of equal texts only those with the smallest id take part; the others go whole.
1. Texts are gathered in packs; each pack lists its anchors' hashes; hashes that only one document has
   are done with.
2. For the others a pack sends what precedes the anchor and what follows it, as far as its windows reach. Those
   that agree on the KMER bytes meet in one bucket. What follows, and what precedes read
   backwards, are put in suffix order: multikey quicksort, eight bytes at a time, down to SHALLOW bytes; what
   is still equal there has a long common prefix and is ordered by blind tries. In that order the common
   prefix lengths of neighbours say which windows are equal, for every distance from the anchor at once.
3. Packs take out what is covered.

An anchor that more than HOT documents share is not sorted: its windows are grouped by their bytes,
pre-summed to the smallest id per pack, so a passage in a third of all documents is spread over all tasks.
Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import mix
from tillroll.session import settle

WINDOW = 50
KMER = 16
#: Bytes sorted by quicksort before blind tries take over.
SHALLOW = 24
PACK_BYTES = 4 << 20
#: Documents at one anchor above which its windows are grouped instead of sorted.
HOT = 5_000
#: Bytes whose anchors are found at once, and bits for a place among them.
PIECE, PLACE = 1 << 20, np.uint64((1 << 22) - 1)
NO_ID = np.iinfo(np.int64).max


# ---- anchors -------------------------------------------------------------------


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(owners, offsets, bytes) of groups of texts; long ones are cut with the overlap that leaves
    every window in exactly one piece."""
    owners, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if parts and size + len(part) > PIECE:
                yield np.array(owners), np.array(offsets), parts
                owners, offsets, parts, size = [], [], [], 0
            owners.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(owners), np.array(offsets), parts


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All anchors of the texts' windows: text number, place in the text, distance to the start of the
    last and of the first of its windows (which are neighbours), hash of the KMER bytes."""
    out = []
    for owners, offsets, parts in _pieces(texts):
        joined = b"".join(parts) + b"\0" * (KMER + 8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        n = int(bounds[-1])
        if n < WINDOW:
            continue
        view = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
        h = mix(mix(view[:n]) + view[8 : n + 8])
        low = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
        span, width = WINDOW - KMER + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = span - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        starts = np.arange(min(len(low), n - WINDOW + 1))
        part = np.searchsorted(bounds, starts, side="right") - 1
        starts = starts[starts + WINDOW <= bounds[part + 1]]
        at = (low[starts] & PLACE).astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        last = np.append(new[1:], len(starts)) - 1
        a = at[new]
        part = np.searchsorted(bounds, starts[new], side="right") - 1
        out.append((owners[part], a - bounds[part] + offsets[part], a - starts[last], a - starts[new], h[a]))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


# ---- deep-shallow sorting --------------------------------------------------------


class Trie:
    """A blind trie: inner nodes hold only the depth at which their children differ."""

    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int | None = None):
        self.depth, self.children, self.leaf = depth, {}, leaf


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_sort(strings: list[bytes], members: list[int], depth: int) -> list[int]:
    """The members (distinct strings, equal up to ``depth``) in order. A string walks down by the bytes at the
    branching depths alone, is compared once with a leaf it comes to, and is put in where they differ."""

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1  # a prefix comes first

    root = Trie(len(strings[members[0]]), members[0])
    for m in members[1:]:
        s, node = strings[m], root
        path = []
        while node.leaf is None:
            path.append(node)
            node = node.children.get(byte(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node.leaf]
        d = common(s, other, depth)
        above = None
        node = root
        while node.leaf is None and node.depth < d:
            above, node = node, node.children[byte(s, node.depth)]
        if node.leaf is None and node.depth == d:
            node.children[byte(s, d)] = Trie(0, m)
            continue
        branch = Trie(d)
        branch.children = {byte(other, d): node, byte(s, d): Trie(0, m)}
        if above is None:
            root = branch
        else:
            above.children[byte(s, above.depth)] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf is not None:
            out.append(node.leaf)
        else:
            stack.extend(node.children[k] for k in sorted(node.children, reverse=True))
    return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct strings, and the common prefix of each with the one before it in that order."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    wide = max(SHALLOW, 8)
    block = np.frombuffer(b"".join(s[:wide].ljust(wide, b"\0") for s in strings), dtype=">u8").reshape(n, wide // 8)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # by place in the order
    open_ = np.arange(n) if n > 1 else np.empty(0, dtype=np.int64)  # places still tied
    for level in range(wide // 8):
        if not len(open_):
            break
        # shorter first where only the padding would tell
        reach = np.minimum(sizes[order[open_]], 8 * level + 8)
        by = np.lexsort((reach, block[order[open_], level], group[open_]))
        order[open_] = order[open_][by]
        key, reach, old = block[order[open_], level], reach[by], group[open_]
        new = np.ones(len(open_), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1]) | (reach[1:] != reach[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        ends = np.append(np.flatnonzero(new), len(open_))
        open_ = open_[np.repeat(np.diff(ends) > 1, np.diff(ends))]
    if len(open_):
        cut = np.flatnonzero(np.diff(group[open_], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(open_))):
            places = open_[a:b]
            order[places] = blind_sort(strings, order[places].tolist(), min(wide, len(strings[order[places[0]]])))
    in_order = [strings[i] for i in order.tolist()]
    lcp = np.fromiter((common(a, b) for a, b in zip(in_order, in_order[1:])), dtype=np.int64, count=max(n - 1, 0))
    return order, np.concatenate([[0], lcp]) if n else np.empty(0, dtype=np.int64)


def classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each string among the distinct ones, and the distinct ones' common prefixes."""
    distinct = list(dict.fromkeys(strings))
    number = {s: i for i, s in enumerate(distinct)}
    order, lcp = deep_shallow(distinct)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[order] = np.arange(len(distinct))
    return rank[np.fromiter(map(number.__getitem__, strings), dtype=np.int64, count=len(strings))], lcp


# ---- the Spark steps ----------------------------------------------------------------


class Pack:
    """A pack's rows in an order that does not depend on how they arrived. Copies are texts that another
    row with a smaller id has whole; they are read as empty, and are removed if a window fits."""

    def __init__(self, table: pa.Table, copies: pa.Table):
        known = copies.filter(pc.is_valid(copies.column("copy")))
        known = set(zip(known.column("copy").to_pylist(), known.column("copy_rank").to_pylist()))
        columns = (table.column(c).to_pylist() for c in ("doc_id", "digest", "bytes"))
        rows = sorted(((NO_ID if i is None else i, d, t, i) for i, d, t in zip(*columns)), key=lambda r: r[:2])
        self.rank = np.array([r[0] for r in rows], dtype=np.int64)
        self.copied = [(d, rank) in known for rank, d, _, _ in rows]
        self.whole = [r[2] for r in rows]
        self.texts = [b"" if c else t for c, t in zip(self.copied, self.whole)]
        self.ids = [r[3] for r in rows]


def _several(rank: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a pack, and the number of distinct ids that have each."""
    order = np.lexsort((rank[owner], h))
    h, d = h[order], rank[owner][order]
    first = np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0
    fresh = first | (np.diff(d, prepend=0) != 0)
    at = np.flatnonzero(first)
    return h[at], np.add.reduceat(fresh.astype(np.int64), at) if len(at) else at


def _list(n_rows: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rows)]), pa.int32()), values)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    order = np.argsort(bucket, kind="stable")
    which, n = np.unique(bucket, return_counts=True)
    return order, which, n.tolist()


def _hashes(buckets: int):
    def run(key: tuple, docs: pa.Table, copies: pa.Table) -> pa.Table:
        pack = Pack(docs, copies)
        pack_number = (docs.column("pack") if len(docs) else copies.column("at"))[0].as_py()
        owner, _, _, _, h = anchors(pack.texts)
        distinct, n = _several(pack.rank, owner, h)
        order, which, sizes = _by_bucket((distinct % np.uint64(buckets)).astype(np.int64), buckets)
        return pa.table({
            "bucket": pa.array(which, pa.int64()), "pack": pa.array(np.full(len(which), pack_number), pa.int64()),
            "hashes": _list(sizes, pa.array(distinct[order].view(np.int64))), "n": _list(sizes, pa.array(n[order])),
        })

    return run


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))


def _shared(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Hashes that more than one document may have: returned to every pack that has them."""
        values, row = _flat(table.column("hashes"))
        h, n = values.to_numpy(), _flat(table.column("n"))[0].to_numpy()
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] ^ 1))
        total = np.add.reduceat(n[order], first) if len(first) else first
        total = np.repeat(total, np.diff(np.append(first, len(h))))
        back = np.empty_like(total)
        back[order] = total
        keep = back > 1
        sizes = np.bincount(row[keep], minlength=len(table))
        return pa.table({
            "at": table.column("pack"), "hashes": _list(sizes, pa.array(h[keep])),
            "hot": _list(sizes, pa.array(back[keep] > hot)),
        })

    return run


class Met:
    """A pack's anchors with the given hashes, those shared with another document; ``hot`` by hash."""

    def __init__(self, pack: Pack, hashes: np.ndarray, hot: np.ndarray):
        owner, at, low, high, h = anchors(pack.texts)
        order = np.argsort(hashes)
        hashes, hot = hashes[order], hot[order]
        i = np.minimum(np.searchsorted(hashes, h.view(np.int64)), max(len(hashes) - 1, 0))
        keep = hashes[i] == h.view(np.int64) if len(hashes) else np.zeros(len(h), dtype=bool)
        self.owner, self.at, self.low, self.high, self.h = (x[keep] for x in (owner, at, low, high, h))
        self.hot = hot[i[keep]].astype(bool)


def _contexts(buckets: int):
    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        pack = Pack(docs, shared)
        met = Met(pack, *(_flat(shared.column(c))[0].to_numpy(zero_copy_only=False) for c in ("hashes", "hot")))
        i = np.flatnonzero(~met.hot)
        order, which, sizes = _by_bucket((met.h[i] % np.uint64(buckets)).astype(np.int64), buckets)
        i = i[order]
        rows = zip(met.owner[i].tolist(), met.at[i].tolist(), met.low[i].tolist(), met.high[i].tolist())
        left, right = [], []
        for o, a, low, high in rows:
            t = pack.texts[o]
            left.append(t[a - high : a])
            right.append(t[a : a + WINDOW - low])
        n = len(which)
        cold = {
            "bucket": pa.array(which, pa.int64()), "pack": pa.array(np.full(n, key[0].as_py()), pa.int64()),
            "before": _list(sizes, pa.array(left, pa.binary())), "behind": _list(sizes, pa.array(right, pa.binary())),
            "low": _list(sizes, pa.array(met.low[i], pa.int8())), "rank": _list(sizes, pa.array(pack.rank[met.owner[i]])),
            "owner": _list(sizes, pa.array(met.owner[i], pa.int32())), "place": _list(sizes, pa.array(met.at[i], pa.int32())),
            "windows": pa.nulls(n, pa.list_(pa.binary())), "smallest": pa.nulls(n, pa.list_(pa.int64())),
        }
        best: dict[bytes, int] = {}
        for _, w, rank in _hot_windows(pack, met):
            if rank < best.get(w, NO_ID + 1):
                best[w] = rank
        windows = list(best)
        bucket = np.fromiter((crc32(w) % buckets for w in windows), dtype=np.int64, count=len(windows))
        order, which, sizes = _by_bucket(bucket, buckets)
        m = len(which)
        hot = {c: pa.nulls(m, a.type) for c, a in cold.items()} | {
            "bucket": pa.array(which, pa.int64()), "pack": pa.array(np.full(m, key[0].as_py()), pa.int64()),
            "windows": _list(sizes, pa.array([windows[j] for j in order], pa.binary())),
            "smallest": _list(sizes, pa.array([best[windows[j]] for j in order], pa.int64())),
        }
        return pa.concat_tables([pa.table(cold), pa.table(hot)])

    return run


CONTEXT = (
    "bucket bigint, pack bigint, before array<binary>, behind array<binary>, low array<tinyint>, rank array<bigint>, "
    "owner array<int>, place array<int>, windows array<binary>, smallest array<bigint>"
)


def _hot_windows(pack: Pack, met: Met) -> Iterator[tuple[tuple[int, int], bytes, int]]:
    """((text, start), window, id) for every window of a hot anchor."""
    i = np.flatnonzero(met.hot)
    for o, a, low, high in zip(*(x[i].tolist() for x in (met.owner, met.at, met.low, met.high))):
        t, rank = pack.texts[o], int(pack.rank[o])
        for start in range(a - high, a - low + 1):
            yield (o, start), t[start : start + WINDOW], rank


def _earlier(table: pa.Table) -> pa.Table:
    """Which windows of a bucket also start in a document with a smaller id: for anchors a bit for each
    distance, for windows of hot anchors the smallest id, sent to the packs that have a larger one."""
    hot = table.filter(pc.is_valid(table.column("windows")))
    table = table.filter(pc.is_valid(table.column("before")))
    windows, row = _flat(hot.column("windows"))
    windows, own = windows.to_pylist(), _flat(hot.column("smallest"))[0].to_pylist()
    pack_of = hot.column("pack").to_numpy()[row].tolist()
    best: dict[bytes, int] = {}
    for w, rank in zip(windows, own):
        if rank < best.get(w, NO_ID + 1):
            best[w] = rank
    again = [(p, w, best[w]) for p, w in zip(pack_of, windows)]
    told = pa.table({
        "at": pa.array([x[0] for x in again], pa.int64()), "owner": pa.nulls(len(again), pa.int32()),
        "place": pa.nulls(len(again), pa.int32()), "mask": pa.nulls(len(again), pa.int64()),
        "window": pa.array([x[1] for x in again], pa.binary()), "smallest": pa.array([x[2] for x in again], pa.int64()),
    })
    return pa.concat_tables([_sorted_out(table), told])


def _sorted_out(table: pa.Table) -> pa.Table:
    before, behind = (_flat(table.column(c))[0].to_pylist() for c in ("before", "behind"))
    values, row = _flat(table.column("low"))
    low = values.to_numpy().astype(np.int64)
    rank, owner, place = (_flat(table.column(c))[0].to_numpy() for c in ("rank", "owner", "place"))
    high = np.fromiter(map(len, before), dtype=np.int64, count=len(before))
    right, right_lcp = classes(behind)
    left, left_lcp = classes([b[::-1] for b in before])
    mask = np.zeros(len(low), dtype=np.int64)
    for d in range(WINDOW - KMER + 1):
        i = np.flatnonzero((low <= d) & (d <= high))
        if not len(i):
            continue
        # windows at this distance are equal if d bytes before and the rest behind are
        same_right = np.cumsum(right_lcp < WINDOW - d)[right[i]]
        same_left = np.cumsum(left_lcp < d)[left[i]]
        key = (same_left << 32) | same_right
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        least = np.minimum.reduceat(rank[i[order]], first)
        least = np.repeat(least, np.diff(np.append(first, len(i))))
        j = i[order]
        mask[j[rank[j] > least]] |= 1 << d
    packs = table.column("pack").to_numpy()
    hit = mask != 0
    return pa.table({
        "at": pa.array(packs[row[hit]]), "owner": pa.array(owner[hit], pa.int32()), "place": pa.array(place[hit], pa.int32()), "mask": pa.array(mask[hit]),
        "window": pa.nulls(int(hit.sum()), pa.binary()), "smallest": pa.nulls(int(hit.sum()), pa.int64()),
    })


FOUND = "at bigint, owner int, place int, mask bigint, window binary, smallest bigint"


def _cut(docs: pa.Table, found: pa.Table) -> Iterator[tuple]:
    """(id, bytes, starts and ends of the runs removed) of each row of a pack."""
    pack = Pack(docs, found)
    removed: dict[int, list[np.ndarray]] = {}
    hot = found.filter(pc.is_valid(found.column("window")))
    cold = found.filter(pc.is_valid(found.column("mask")))
    owner, place, mask = (cold.column(c).to_numpy() for c in ("owner", "place", "mask"))
    order = np.argsort(owner, kind="stable")
    owner, place, mask = owner[order], place[order], mask[order]
    for d in range(WINDOW - KMER + 1):
        i = np.flatnonzero((mask >> d) & 1)
        cut = np.flatnonzero(np.diff(owner[i], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(i))):
            removed.setdefault(int(owner[i[a]]), []).append(place[i[a:b]] - d)
    if len(hot):
        best = dict(zip(hot.column("window").to_pylist(), hot.column("smallest").to_pylist()))
        # a window's own anchor says which of the pack's anchors are hot
        hashes = np.unique(anchors(list(best))[4].view(np.int64))
        for (o, start), w, rank in _hot_windows(pack, Met(pack, hashes, np.ones(len(hashes), dtype=bool))):
            if rank > best.get(w, NO_ID):
                removed.setdefault(o, []).append(np.array([start]))
    for i, t in enumerate(pack.whole):
        if i not in removed:
            n = int(pack.copied[i] and len(t) >= WINDOW)
            yield pack.ids[i], t, np.zeros(n, dtype=np.int64), np.full(n, len(t))
            continue
        starts = np.unique(np.concatenate(removed[i]))
        gap = np.flatnonzero(np.diff(starts) > WINDOW)
        yield pack.ids[i], t, starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + WINDOW


def kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)]))


def _digests(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    rows = [
        (i, len(t), int((ends - starts).sum()), len(starts), sha256(kept(t, starts, ends)).hexdigest())
        for i, t, starts, ends in _cut(docs, found)
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows) if rows else [()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    rows = [
        (i, kept(t, starts, ends), [[a, b] for a, b in zip(starts.tolist(), ends.tolist())])
        for i, t, starts, ends in _cut(docs, found)
    ]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
    columns = zip(*rows) if rows else [()] * 3
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kept", "spans"])


def _deduplicate(docs: DataFrame, last, schema: str, pack_bytes: int, hot: int) -> DataFrame:
    content = F.coalesce("text", F.lit("")).cast("binary")
    source = docs.select("doc_id", content.alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256)))
    rows = settle(source.select("doc_id", "digest", F.octet_length("bytes").alias("size")))
    packs = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // pack_bytes))
    buckets = max(1, packs // 2)
    pack = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(packs))
    source = source.select(pack.alias("pack"), "doc_id", "digest", "bytes")
    rank = F.coalesce("doc_id", F.lit(NO_ID))
    firsts = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = settle(
        rows.select(pack.alias("at"), F.col("digest").alias("copy"), rank.alias("copy_rank"))
        .join(firsts, F.col("copy") == F.col("digest")).where("copy_rank > first").select("at", "copy", "copy_rank").distinct()
    )
    # one plan: the three steps that read the packs share one exchange of the texts
    listed = source.groupBy("pack").cogroup(copies.groupBy("at")).applyInArrow(
        _hashes(buckets), "bucket bigint, pack bigint, hashes array<bigint>, n array<bigint>"
    )
    shared = listed.groupBy("bucket").applyInArrow(_shared(hot), "at bigint, hashes array<bigint>, hot array<boolean>")
    shared = shared.unionByName(copies, allowMissingColumns=True)
    contexts = source.groupBy("pack").cogroup(shared.groupBy("at")).applyInArrow(_contexts(buckets), CONTEXT)
    found = contexts.groupBy("bucket").applyInArrow(_earlier, FOUND).unionByName(copies, allowMissingColumns=True)
    return source.groupBy("pack").cogroup(found.groupBy("at")).applyInArrow(last, schema)


def removals(docs: DataFrame, pack_bytes: int = PACK_BYTES, hot: int = HOT) -> DataFrame:
    """Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id bigint,
    text): UTF-8 bytes, those removed, the maximal removed runs, and the digest of what is left.

    A byte is removed if a 50-byte string over it also starts in a row with a smaller doc_id; strings are
    those of the input. Null is empty. Rows of one id take nothing from each other; rows without an id
    come after all others and take nothing from each other. Other columns are ignored; an empty table
    gives no rows.
    """
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _deduplicate(docs, _digests, schema, pack_bytes, hot)


def deduplicated(docs: DataFrame, pack_bytes: int = PACK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, kept binary, spans): what is left of each text, and the [start, end) runs removed. What is
    left need not be whole UTF-8 characters."""
    return _deduplicate(docs, _texts, "doc_id bigint, kept binary, spans array<array<bigint>>", pack_bytes, hot)
