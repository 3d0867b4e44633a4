"""Phrases whose words belong together, counted over a prefix-free parse.

Method. A text is cut where a hash of three words triggers. A chunk reaches three words into the next one, so every
phrase of up to four words lies whole inside the chunk that its first word belongs to, and is counted
there only. Equal words give equal chunks wherever they stand: the distinct chunks of each language are the
*dictionary*, with the number of times the parse has each. Phrases are counted inside distinct chunks,
weighted by that number; copied passages cost their text once.

A phrase can occur ``least`` times only if its first and its last words but one do, so phrases grow a word at a
time, over a Bloom filter of the frequent ones of the length before. The filter is sized by their number, up to
BLOOM_BITS; it only leaves out what cannot be frequent, and every count is exact, by the phrase's own text.
Hot phrases are summed in each task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import byte_set, hash_spans, lay, mix, octets, packs
from tillroll.session import settle

#: Words of a phrase, and words that chunks share.
LONGEST = 4
OVERLAP = LONGEST - 1
#: A chunk is about so many words long.
TRIGGER = 64
#: Bits of the filter for each frequent phrase, and in all: 32 MB, whatever the input.
BITS_EACH = 16
BLOOM_BITS = 1 << 28
SEGMENTS = 16
#: Distinct phrases a task sums before it hands them on.
COUNTED = 1 << 20

# after lower-casing: . , ; : ! ? and the control characters line feed to carriage return
BREAK = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
_APART = BREAK | byte_set((0x20, 0x20), (0x09, 0x09))
_LINE, _SPACE = 0x0A, 0x20
_K = np.uint64(0x9E3779B97F4A7C15)


# ---- the parse ------------------------------------------------------------------


def chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
    """(text number, chunk, how many of its words start a phrase that counts here) of each text.

    A chunk is its words with a space between them, or a line feed where a piece ends. The last of a text ends with a
    line feed, and all its words count; in others the last three are the next one's.
    """
    buf, bounds = lay(texts)
    buf[bounds[1:] - 1] = _LINE
    apart = _APART[buf]
    edges = np.flatnonzero(np.diff((~apart).astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    owner = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(BREAK[buf])])
    after = np.append(starts[1:], len(buf))
    last = np.append(owner[1:] != owner[:-1], True)
    stops = (breaks[after] > breaks[ends]) | last
    # words with one byte behind each
    buf[ends] = np.where(stops, _LINE, _SPACE)
    keep = ~apart
    keep[ends] = True
    plain = buf[keep].tobytes()
    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    # triggers: where three words of one text begin whose hash says so
    h = hash_spans(buf, starts, ends - starts)
    rolled = mix(h)
    for j in range(1, OVERLAP):
        rolled = mix(rolled[: max(0, len(h) - j)] * _K + h[j:])
    at = np.flatnonzero(rolled % np.uint64(TRIGGER) == 0)
    at = at[owner[at] == owner[at + OVERLAP - 1]]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    cuts = np.union1d(at, first)
    upto = np.append(cuts[1:], len(starts))
    closed = np.append(owner[cuts[1:]] != owner[cuts[:-1]], True)
    begin, end = place[cuts], np.where(closed, place[upto], place[np.minimum(upto + OVERLAP, len(starts))] - 1)
    for o, a, b, n in zip(owner[cuts].tolist(), begin.tolist(), end.tolist(), (upto - cuts).tolist()):
        yield o, plain[a:b], n


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, pack in packs(octets(batch.column("text"))):
            found = list(chunks(pack))
            if found:
                owner, chunk, words = zip(*found)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([langs[first + o] for o in owner], pa.string()),
                    "chunk": pa.array(chunk, pa.binary()), "words": pa.array(words, pa.int64()),
                })


def dictionary(docs: DataFrame) -> DataFrame:
    """Returns (lang, chunk, words, copies): the distinct chunks of ``docs`` (lang, text) and how often the parse has each."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(_parse, "lang string, chunk binary, words bigint").groupBy("lang", "chunk").agg(
        F.first("words").alias("words"), F.count("*").alias("copies")
    )


# ---- phrases of one length --------------------------------------------------------


def phrases(parts: list[bytes], counting: list[int], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Once: the buffer, and start, end, chunk number and hashes (by length, up to ``size``) of the phrases of ``size`` words."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n" * 9, dtype=np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    apart = (buf == _SPACE) | (buf == _LINE)
    edges = np.flatnonzero(np.diff((~apart).astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    # words of a chunk from its first on: those that count come first
    rank = np.arange(len(starts)) - np.searchsorted(owner, np.arange(len(parts)))[owner]
    counts = rank < np.array(counting, dtype=np.int64)[owner]
    joined = buf[ends] == _SPACE  # to the word behind it
    h = hash_spans(buf, starts, ends - starts)
    hashes, whole = [mix(h)], np.ones(len(h), dtype=bool)
    for j in range(1, size):
        n = max(0, len(h) - j)
        whole = whole[:n] & joined[j - 1 : j - 1 + n]
        hashes.append(mix(hashes[-1][:n] * _K + h[j:]))
    i = np.flatnonzero(whole & counts[: len(whole)])
    yield buf, starts[i], ends[i + size - 1], owner[i], i, hashes


def _in_language(h: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mix(h ^ salts)


def _salts(langs: list[str]) -> np.ndarray:
    known = {lang: hash_spans(np.frombuffer(lang.encode() + b" " * 8, dtype=np.uint8), np.array([0]), np.array([len(lang.encode())]))[0] for lang in set(langs)}
    return np.array([known[lang] for lang in langs], dtype=np.uint64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, and two places in it, of each hash."""
    inside = np.uint64(bits // SEGMENTS - 1)
    return h & np.uint64(SEGMENTS - 1), (h >> np.uint64(8)) & inside, mix(h) & inside


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``bloom``: SEGMENTS rows of packed bits."""
    segment, *places = _places(h, bloom.size * 8)
    out = np.ones(len(h), dtype=bool)
    for p in places:
        out &= (bloom[segment, p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _hash_phrases(words: list[bytes], langs: list[str], size: int) -> np.ndarray:
    buf, starts, ends, owner, i, hashes = next(phrases(words, [1] * len(words), size))
    return _in_language(hashes[size - 1][i], _salts(langs)[owner])


def _mark(size: int, bits: int):
    """The filter's segments, of the phrases that come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: dict[int, np.ndarray] = {}
        for batch in batches:
            h = _hash_phrases(octets(batch.column("phrase")), batch.column("lang").to_pylist(), size)
            segment, *places = _places(h, bits)
            for s in np.unique(segment).tolist():
                row = marked.setdefault(s, np.zeros(bits // SEGMENTS // 8, dtype=np.uint8))
                for p in places:
                    p = p[segment == s]
                    np.bitwise_or.at(row, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(list(marked), pa.int32()), "bits": pa.array([m.tobytes() for m in marked.values()], pa.binary()),
        })

    return run


def bloom(frequent: DataFrame, size: int) -> np.ndarray:
    """A filter of the phrases (lang, phrase) of ``size`` words, at most BLOOM_BITS in all."""
    wanted = max(1 << 16, BITS_EACH * frequent.count())
    bits = min(BLOOM_BITS, 1 << (wanted - 1).bit_length())
    marks = frequent.select("lang", "phrase").mapInArrow(_mark(size, bits), "segment int, bits binary")
    out = np.zeros((SEGMENTS, bits // SEGMENTS // 8), dtype=np.uint8)
    together = marks.repartition(SEGMENTS, "segment").mapInArrow(_together, "segment int, bits binary")
    for r in together.collect():
        out[r["segment"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, b in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
            row = np.frombuffer(b, dtype=np.uint8)
            total[s] = total[s] | row if s in total else row
    yield pa.RecordBatch.from_pydict({
        "segment": pa.array(list(total), pa.int32()), "bits": pa.array([t.tobytes() for t in total.values()], pa.binary()),
    })


class _Sums:
    """Counts of phrases by hash, each with its text and language once."""

    def __init__(self):
        self.hashes, self.counts, self.texts, self.langs = [], [], [], []
        self.held = 0

    def add(self, h, n, text, lang):
        self.hashes.append(h)
        self.counts.append(n)
        self.texts.append(text)
        self.langs.append(lang)
        self.held += len(h)

    def rows(self) -> pa.RecordBatch:
        h, first, back = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        n = np.zeros(len(h), dtype=np.int64)
        np.add.at(n, back, np.concatenate(self.counts))
        first = pa.array(first)
        return pa.RecordBatch.from_pydict({
            "lang": pa.concat_arrays(self.langs).take(first), "phrase": pa.concat_arrays(self.texts).take(first).cast(pa.string()),
            "n": pa.array(n),
        })


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a column, copied as a whole."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = buf[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _counts(size: int, shared):
    """(lang, phrase, n): a task's sums of the phrases of ``size`` words whose parts pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value if shared is not None else None
        sums = _Sums()
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), batch.column("words").to_pylist()
            copies = batch.column("copies").to_numpy()
            for first, pack in packs(octets(batch.column("chunk"))):
                to = first + len(pack)
                salts = _salts(langs[first:to])
                buf, starts, ends, owner, i, hashes = next(phrases(pack, words[first:to], size))
                if filter_ is not None and len(i):
                    # the first and the last words but one
                    ok = passes(filter_, _in_language(hashes[size - 2][i], salts[owner]))
                    ok[ok] = passes(filter_, _in_language(hashes[size - 2][i[ok] + 1], salts[owner[ok]]))
                    starts, ends, owner, i = starts[ok], ends[ok], owner[ok], i[ok]
                h, at, back = np.unique(_in_language(hashes[size - 1][i], salts[owner]), return_index=True, return_inverse=True)
                n = np.bincount(back, copies[first:to][owner], minlength=len(h)) if len(h) else np.zeros(0)
                if len(h):
                    sums.add(h, n.astype(np.int64), _texts(buf, starts[at], ends[at]), pa.array(langs[first:to], pa.string()).take(pa.array(owner[at])))
            if sums.held > COUNTED:
                yield sums.rows()
                sums = _Sums()
        if sums.held:
            yield sums.rows()

    return run


def frequent_phrases(words: DataFrame, least: int) -> list[DataFrame]:
    """(lang, phrase, n) of the phrases of 1, 2, 3 and 4 words that occur ``least`` times, from a dictionary."""
    spark = words.sparkSession
    out: list[DataFrame] = []
    for size in range(1, LONGEST + 1):
        shared = spark.sparkContext.broadcast(bloom(out[-1], size - 1)) if out else None
        parts = words.select("lang", "chunk", "words", "copies").mapInArrow(_counts(size, shared), "lang string, phrase string, n bigint")
        out.append(settle(parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)))
    return out


# ---- scores ------------------------------------------------------------------------


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80) -> DataFrame:
    """Returns (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (lang, text).

    Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and line ends into pieces, these at spaces and tabs into words. Of
    a language (null: ``und``), n counts the words and f a phrase's occurrences inside pieces, overlaps included.
    Phrases of 2 to 4 words with a = f >= ``least`` (at least 1) are candidates. The cut after the first k words
    gives l and r, the counts of both sides, and floor(2000000 a / (l + r)); the lowest counts, ties to the smallest k. A candidate inside
    a longer one with 100 f(longer) >= ``covered`` a is dropped. Ranks go by score and a (largest first), then
    phrase. Null and empty texts have no words; repeated rows count each time; other columns are ignored; an empty table gives no rows.
    """
    chunk_table = settle(dictionary(docs))
    totals = chunk_table.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("n"))
    singles, *longer = frequent_phrases(chunk_table, least)
    candidates = longer[0].unionByName(longer[1]).unionByName(longer[2])
    every = singles.unionByName(candidates)
    words = F.split("phrase", " ", -1)
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("size"))

    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), k).alias("left"), _part(F.col("words"), k + 1, F.col("size") - k).alias("right")
    )
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(every.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    exact = (F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")).alias("times")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", exact, (F.col("l").cast("decimal(19,0)") + F.col("r")).alias("sides"))
    scored = cuts.withColumn("score", F.expr("times div sides")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    # the parts of longer candidates, with the largest count of those that hold them
    size, at = F.col("size"), F.col("at")
    inside = candidates.where("size > 2").withColumn("part", F.explode(F.sequence(F.lit(2), size - 1))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), size - F.col("part") + 1))
    )
    holders = inside.select("lang", _part(F.col("words"), at, F.col("part")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    is_inside = F.col("most").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * covered
    left = scored.join(holders, ["lang", "phrase"], "left").where(~F.coalesce(is_inside, F.lit(False)))
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ).where(F.col("rank") <= top)
    # languages are as many rows as the totals have
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
