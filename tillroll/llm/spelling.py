"""Spelling variants: words one edit apart, found through a trie of letter counts.

Method. Letters are dealt to GROUPS groups of about equal use, and a word's *vector* says how many of its
letters each group has. One edit adds at most one to one group (surplus) and takes at most one from one
(deficit). Words are arranged in a trie by the successive numbers of their vectors; a word's search goes
through it depth first and may spend a surplus and a deficit of one each; words at the leaves it reaches
are verified letter by letter. Nearness is mutual, so a search spends its deficit only after its
surplus: each pair is met once, from the word with the smaller vector.

The trie is dealt over tasks. Nodes with more words than a task should hold are *inner*; there are at most
GROUPS * INNER_NODES of them, whatever the vocabulary, and only they reach the driver. A word lives in the
cell of its first node that is not inner, and is sent as a question to every cell its search can reach. A
last node with too many words (one vector, many words) is split in blocks, and its questions go to all.
Cells are named by 64-bit hashes; two cells of one name would be searched together, at no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import sums
from tillroll.llm.text import lay, mix, octets, packs
from tillroll.session import settle

GROUPS = 24
#: A level of the trie has at most so many inner nodes.
INNER_NODES = 10_000
#: Words of a cell, unless the vocabulary is larger than this times INNER_NODES.
CELL_WORDS = 20_000
#: Distinct words a task counts before it hands them on.
COUNTED = 200_000
#: Below so many (question, word) pairs a node's words are compared as a whole.
LEAF_PAIRS = 1 << 14
#: Pairs of words verified at a time.
PAIRS = 1 << 18
#: Longer words are verified one by one, so that one of them does not widen the table of all.
WIDE = 48

_CRC = np.array([(lambda c: [c := (c >> 1) ^ (0xEDB88320 if c & 1 else 0) for _ in range(8)][-1])(i) for i in range(256)], dtype=np.uint32)
_K = np.uint64(0x9E3779B97F4A7C15)
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8


# ---- words and their counts -----------------------------------------------------


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts, ends, code points and text number of all maximal runs of letters, A-Z lower-cased."""
    buf, bounds = lay(texts)
    lead = buf == _LEAD
    inside = ((buf >= ord("a")) & (buf <= ord("z"))) | lead
    inside[1:] |= lead[:-1]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (leads[ends] - leads[starts])
    return buf, starts, ends, points, np.searchsorted(bounds, starts, side="right") - 1


def crc32_from(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span, continued from ``state`` (a finished crc32 each)."""
    out = state ^ np.uint32(0xFFFFFFFF)
    live = np.arange(len(starts))
    at, end, c = starts.copy(), ends, out.copy()
    while len(live):
        c = _CRC[(c ^ buf[at]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        out[live] = c
        at = at + 1
        more = at < end
        if not more.all():
            live, at, end, c = live[more], at[more], end[more], c[more]
    return out ^ np.uint32(0xFFFFFFFF)


def _counted(every: int, least: int):
    """(word, n) of the words of at least ``least`` letters; one of ``every`` runs has a letter taken out."""

    def flush(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "word": pa.array(counts.keys(), pa.binary()).cast(pa.string()), "n": pa.array(counts.values(), pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, pack in packs(octets(batch.column("text"))):
                buf, starts, ends, points, owner = runs(pack)
                # a letter may be taken out, but none is put in: shorter runs give no word
                long = points >= least
                starts, ends, points, owner = starts[long], ends[long], points[long], owner[long]
                names = ["" if i is None else str(i) for i in ids[first : first + len(pack)]]
                state = np.array([zlib.crc32(f"{i}:".encode()) for i in names], dtype=np.uint32)
                h = crc32_from(state[owner], buf, starts, ends)
                cut = h % np.uint32(every) == 0
                data = buf.tobytes()
                for a, b in zip(starts[~cut].tolist(), ends[~cut].tolist()):
                    word = data[a:b]
                    counts[word] = counts.get(word, 0) + 1
                for a, b, size, x in zip(starts[cut].tolist(), ends[cut].tolist(), points[cut].tolist(), h[cut].tolist()):
                    if size > least:
                        word = data[a:b].decode()
                        word = (word[: x % size] + word[x % size + 1 :]).encode()
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) > COUNTED:
                    yield flush(counts)
                    counts = {}
        yield flush(counts)

    return run


def word_counts(docs: DataFrame, every: int = 199, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """Returns (word, n): the words of ``docs`` (doc_id, text) and how often they occur.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. h is the crc32 of
    ``<doc_id>:<run>`` (a null doc_id: nothing before the colon); where ``every`` divides h, the run's code point
    h % length is deleted. Kept are words of at least ``least_letters`` code points that occur at
    least ``least_n`` times. A null text has none.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(every, least_letters), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# ---- vectors and the trie ---------------------------------------------------------


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words (in Latin-1: a byte each) and whose they are."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(np.arange(len(words)), sizes)


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for batch in batches:
        total += np.bincount(letters([w.encode("latin-1") for w in batch.column("word").to_pylist()])[0], minlength=256)
    ids, parts = sums.segments(total)
    yield pa.RecordBatch.from_pydict({"segment": pa.array(ids, pa.int32()), "counts": pa.array(parts, pa.binary())})


def letter_groups(counts: np.ndarray) -> np.ndarray:
    """The group of each letter: the next most used letter goes to the group least used so far."""
    group, load = np.zeros(256, dtype=np.int64), np.zeros(GROUPS, dtype=np.int64)
    for letter in np.lexsort((np.arange(256), -counts)):
        group[letter] = np.argmin(load)
        load[group[letter]] += max(1, counts[letter])
    return group


def vectors(words: list[bytes], group: np.ndarray) -> np.ndarray:
    """Counts from 100 on are 100: no two words come further apart by it, and letters are verified."""
    letter, owner = letters(words)
    counts = np.bincount(owner * GROUPS + group[letter], minlength=len(words) * GROUPS)
    return np.minimum(counts, 100).astype(np.int8).reshape(-1, GROUPS)


def _step(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Names of the nodes reached from ``node`` by ``count``; the root is 0."""
    return mix((node + _K) * _K + count.astype(np.uint64))


def _find(inner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each node is inner, and its place there."""
    at = np.minimum(np.searchsorted(inner, node), len(inner) - 1) if len(inner) else np.zeros(len(node), dtype=np.int64)
    return (inner[at] == node if len(inner) else np.zeros(len(node), dtype=bool)), at


def _nodes_below(group: np.ndarray, depth: int, inner: np.ndarray):
    """(node, n) of the nodes at ``depth`` under inner ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()], group)
            node = np.zeros(len(vec), dtype=np.uint64)
            for d in range(depth):
                live = _find(inner, node)[0]
                vec, node = vec[live], _step(node[live], vec[live, d])
            node, n = np.unique(node, return_counts=True)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "n": pa.array(n)})

    return run


def inner_nodes(words: DataFrame, group: np.ndarray, total: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the nodes with more than ``cell`` words, and how many words each has. A level has at most
    total / cell of them."""
    inner, sizes = (np.zeros(1, dtype=np.uint64), np.array([total])) if total > cell else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for depth in range(1, GROUPS + 1):
        found = []
        if len(inner):
            nodes = words.select("word").mapInArrow(_nodes_below(group, depth, inner), "node bigint, n bigint")
            found = nodes.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > cell).collect()
        if not found:
            break
        inner = np.concatenate([inner, np.array([r["node"] for r in found], dtype=np.int64).view(np.uint64)])
        sizes = np.concatenate([sizes, np.array([r["n"] for r in found])])
        order = np.argsort(inner)
        inner, sizes = inner[order], sizes[order]
    return inner, sizes


def homes(vec: np.ndarray, words: list[bytes], inner: np.ndarray, sizes: np.ndarray, cell: int) -> np.ndarray:
    """The cell of each word."""
    node, live = np.zeros(len(vec), dtype=np.uint64), np.arange(len(vec))
    for d in range(GROUPS):
        live = live[_find(inner, node[live])[0]]
        node[live] = _step(node[live], vec[live, d])
    full, at = _find(inner, node)
    for i in np.flatnonzero(full):
        node[i] = _block(node[i : i + 1], np.array([zlib.crc32(words[i]) % -(-sizes[at[i]] // cell)]))[0]
    return node


def _block(node: np.ndarray, block: np.ndarray) -> np.ndarray:
    return mix(node ^ (block.astype(np.uint64) + np.uint64(1)) * _K)


def asked(vec: np.ndarray, inner: np.ndarray, sizes: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell) for each cell that a word's search can reach."""
    word, node = np.arange(len(vec)), np.zeros(len(vec), dtype=np.uint64)
    surplus = deficit = np.zeros(len(vec), dtype=bool)
    out_word, out_cell = [], []
    for d in range(GROUPS + 1):
        going, at = _find(inner, node)
        out_word.append(word[~going])
        out_cell.append(node[~going])
        word, node, surplus, deficit, at = word[going], node[going], surplus[going], deficit[going], at[going]
        if not len(word):
            break
        if d == GROUPS:  # one vector with too many words: all its blocks
            blocks = -(-sizes[at] // cell)
            which = np.repeat(np.arange(len(word)), blocks)
            block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            out_word.append(word[which])
            out_cell.append(_block(node[which], block))
            break
        count = vec[word, d]
        up, down = ~surplus, surplus & ~deficit & (count > 0)
        node = np.concatenate([_step(node, count), _step(node[up], count[up] + 1), _step(node[down], count[down] - 1)])
        surplus, deficit = (
            np.concatenate([surplus, np.ones(up.sum(), dtype=bool), surplus[down]]),
            np.concatenate([deficit, deficit[up], np.ones(down.sum(), dtype=bool)]),
        )
        word = np.concatenate([word, word[up], word[down]])
    pairs = np.stack([np.concatenate(out_word).astype(np.uint64), np.concatenate(out_cell)], axis=1)
    pairs = np.unique(pairs, axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def _deal(shared, group: np.ndarray, cell: int):
    """Each word at home in its cell, and as a question in all cells its search reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, sizes = shared.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            n = batch.column("n").to_numpy()
            vec = vectors(words, group)
            who, where = asked(vec, inner, sizes, cell)
            who = np.concatenate([np.arange(len(words)), who])
            where = np.concatenate([homes(vec, words, inner, sizes, cell), where])
            home = np.arange(len(who)) < len(words)
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(where.view(np.int64)), "home": pa.array(home),
                "word": pa.array(words, pa.binary()).take(pa.array(who)), "n": pa.array(n[who]),
            })

    return run


DEALT = "cell bigint, home boolean, word binary, n bigint"


# ---- the search in one cell -----------------------------------------------------------


def search(home: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, home) pairs of vectors that are a surplus and a deficit of at most one apart, the surplus first. ``home``
    is sorted by its columns: a node of the trie is a range of rows."""
    found_q, found_h = [], []
    none = np.zeros(len(ask), dtype=np.int8)
    stack = [(0, len(home), 0, np.arange(len(ask)), none, none)]
    while stack:
        low, high, depth, q, surplus, deficit = stack.pop()
        if depth == GROUPS or (high - low) * len(q) <= LEAF_PAIRS:
            h, j = _leaf(home[low:high, depth:], ask[q, depth:], surplus, deficit)
            found_h.append(h + low)
            found_q.append(q[j])
            continue
        column = home[low:high, depth]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
        count = ask[q, depth]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            apart = column[a] - count
            go = np.flatnonzero((apart == 0) | ((apart == 1) & (surplus == 0)) | ((apart == -1) & (surplus == 1) & (deficit == 0)))
            if len(go):
                apart = apart[go]
                stack.append((low + a, low + b, depth + 1, q[go], surplus[go] | (apart == 1), deficit[go] | (apart == -1)))
    if not found_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_q), np.concatenate(found_h)


def _leaf(home: np.ndarray, ask: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a few vectors' last parts within the budget, level by level."""
    h, j = np.divmod(np.arange(len(home) * len(ask)), len(ask))
    surplus, deficit = surplus[j], deficit[j]
    for d in range(home.shape[1]):
        apart = home[h, d] - ask[j, d]
        go = np.flatnonzero((apart == 0) | ((apart == 1) & (surplus == 0)) | ((apart == -1) & (surplus == 1) & (deficit == 0)))
        h, j, apart = h[go], j[go], apart[go]
        surplus, deficit = surplus[go] | (apart == 1), deficit[go] | (apart == -1)
    return h, j


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes one of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return head + tail >= max(len(a), len(b)) - 1


def _table(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """The words' letters from the front and from the back, zeros behind; their sizes; and the first and the last few
    letters as a number each. One edit in a word of m letters leaves its first or its last m // 2 alone."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    width = min(WIDE, int(sizes.max(initial=1))) + 1
    letter, owner = letters(words)
    at = np.arange(len(letter)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    front = np.zeros((2, len(words), width), dtype=np.uint8)
    for side, place in enumerate((at, sizes[owner] - 1 - at)):
        fits = place < width
        front[side, owner[fits], place[fits]] = letter[fits]
    few = min(4, int(sizes.min(initial=8)) // 2)
    ends = np.zeros((2, len(words), 4), dtype=np.uint8)
    ends[:, :, :few] = front[:, :, :few]
    head, tail = ends.view("<u4")[:, :, 0]
    return front[0], front[1], sizes, head, tail


def near(tables, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which of the pairs of words are one edit apart."""
    words, front, back, sizes, head, tail = tables
    out = np.zeros(len(j), dtype=bool)
    live = np.flatnonzero((head[j] == head[k]) | (tail[j] == tail[k]))
    j, k = j[live], k[live]
    long = np.maximum(sizes[j], sizes[k])
    ahead, behind = front[j] != front[k], back[j] != back[k]
    ok = ahead.any(axis=1) & (ahead.argmax(axis=1) + behind.argmax(axis=1) >= long - 1)
    for x in np.flatnonzero(long >= front.shape[1]):
        ok[x] = one_edit(words[j[x]], words[k[x]])
    out[live] = ok
    return out


def _word_pairs(home: np.ndarray, ask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, home) pairs of words that ``search`` finds for their vectors, in blocks; both are sorted by vector."""
    firsts = [np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]).any(axis=1)])) for v in (home, ask)]
    sizes = [np.diff(np.append(f, len(v))) for f, v in zip(firsts, (home, ask))]
    q, h = search(home[firsts[0]], ask[firsts[1]])
    pairs = sizes[1][q] * sizes[0][h]
    # a pair of vectors with very many words is cut by its questions
    ends = np.cumsum(pairs)
    for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        x = np.arange(start, min(start + PAIRS, int(ends[-1])))
        p = np.searchsorted(ends, x, side="right")
        x = x - (ends[p] - pairs[p])
        many = sizes[0][h[p]]
        yield firsts[1][q[p]] + x // many, firsts[0][h[p]] + x % many


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct ``own``: how many others, and the other of largest n, smallest rank."""
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.diff(np.append(first, len(own))), other[first]


def _search_cells(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    words = table.column("word").to_pylist()
    n, cell = table.column("n").to_numpy(), table.column("cell").to_numpy()
    home = table.column("home").to_numpy()
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    group = np.frombuffer(table.column("groups")[0].as_py(), dtype=np.uint8).astype(np.int64)
    vec = vectors(words, group)
    order = np.lexsort((*(vec[:, d] for d in range(GROUPS - 1, -1, -1)), ~home, cell))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
    tables = words, *_table(words)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = order[a:b]
        here, there = rows[home[rows]], rows[~home[rows]]
        if not len(here) or not len(there):
            continue
        own_q, own_h = [], []
        for q, h in _word_pairs(vec[here], vec[there]):
            # words of one vector meet twice: once from the smaller one
            twice = (vec[there[q]] == vec[here[h]]).all(axis=1)
            keep = ~twice | (rank[there[q]] < rank[here[h]])
            q, h = q[keep], h[keep]
            sure = near(tables, there[q], here[h])
            own_q.append(there[q[sure]])
            own_h.append(here[h[sure]])
        q, h = np.concatenate(own_q), np.concatenate(own_h)
        out += [_best(q, h, n, rank), _best(h, q, n, rank)]
    own, count, other = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
    text = [w.decode("latin-1") for w in words]
    return pa.table({
        "word": pa.array([text[i] for i in own], pa.string()), "n_near": pa.array(count.astype(np.int64)),
        "near": pa.array([text[i] for i in other], pa.string()), "near_n": pa.array(n[other]),
    })


NEAR = "word string, n_near bigint, near string, near_n bigint"


def near_words(words: DataFrame, cell: int | None = None) -> DataFrame:
    """Returns (word, n_near, near, near_n) for the words of ``words`` (word of letters up to U+00FF, n; no word twice) that have
    others one edit away: how many, and the one of largest n (ties: smallest)."""
    spark = words.sparkSession
    total = words.count()
    cell = cell or max(CELL_WORDS, -(-total // INNER_NODES))
    counts = sums.total(words.select("word").mapInArrow(_letter_counts, sums.SCHEMA), 256)
    group = letter_groups(counts)
    shared = spark.sparkContext.broadcast(inner_nodes(words, group, total, cell))
    dealt = words.select("word", "n").mapInArrow(_deal(shared, group, cell), DEALT)
    # a bucket holds about a cell's worth of words and their questions
    buckets = max(1, -(-total // cell))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    dealt = dealt.withColumn("groups", F.lit(group.astype(np.uint8).tobytes()))
    # a task for each bucket: small in bytes, but not in work
    found = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_search_cells, NEAR)
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    ).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form reached. Forms must not go round; each round doubles the
    steps taken, and a form has ``times`` its word's n, so rounds are few."""
    steps = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = settle(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            return steps


def spelling_variants(
    docs: DataFrame, every: int = 199, least_letters: int = 6, least_n: int = 5, times: int = 5, cell: int | None = None
) -> DataFrame:
    """Returns (word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text).

    Words and n as in ``word_counts``. Words one inserted, deleted or replaced code point apart are near;
    n_near counts a word's. Its form is its near word of largest n (ties: the smallest in code-point order) if that n
    is at least ``times`` (over 1) the word's own, else null; root is the last form reached from it, or itself. Repeated
    rows count each time; null texts and null ids crash nothing; other columns are ignored; an empty
    table gives no rows.
    """
    words = settle(word_counts(docs, every, least_letters, least_n))
    near_ = near_words(words, cell)
    has_form = F.col("near_n") >= times * F.col("n")
    placed = settle(words.join(near_, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"),
    ))
    roots = follow(placed.where("form is not null"))
    return placed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
