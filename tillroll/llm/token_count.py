"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

The tokens of a text's first i characters decide those of the first i + 1: exactly one piece that ends
there fits behind the tokens before it, and a piece fits behind another if the two, merged by the
vocabulary's rules on their own, stay apart. So a deterministic transducer reads a text character by
character. Its states hold the longest suffix that may still grow into a piece and, for each
place in it, the last token and the tokens emitted since; each transition is annotated with the change in
the token count. States and transitions are compiled as texts first need them and kept.

A word mark behind another character always leads to the same state, since no piece crosses it. So a
chunk's map from states to (state, count) is constant from its first such reset on, and is kept as the
characters before the first reset, the count between the first and the last, and the characters after
the last. These maps compose associatively; chunks of long texts are mapped in parallel and combined
pairwise, as in a parallel prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import octets, packs

MARK = "▁"
#: Characters of a chunk; longer texts are cut and spread over tasks.
CHUNK = 1 << 18
#: Bytes of text whose words are held at once.
PACK = 4 << 20
#: Words whose maps a task keeps; more are compiled anew.
WORDS_KEPT = 500_000


class Row(dict):
    """A state: by character, the next state and the change in the token count, as far as compiled."""

    __slots__ = ("suffix", "places")


class Transducer:
    """Counts the pieces of normalised text as sentencepiece's byte-pair model does: single characters,
    merged by score; characters without a piece count as their UTF-8 bytes. Models with other piece
    kinds (user-defined symbols) or pieces that cross a word mark are refused."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a word mark")
        self.prefixes = {p[:i] for p in self.score for i in range(1, len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.states: dict[tuple, Row] = {}
        self.start = self._enter("", ((None, 0),))
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, before: str | None, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = self.merged(piece) == [piece]
        if before is None or not self.whole[piece]:
            return self.whole[piece]
        key = (before, piece)
        if key not in self.apart:
            self.apart[key] = self.merged(before + piece) == [before, piece]
        return self.apart[key]

    def compile(self, state: Row, c: str) -> tuple[Row, int]:
        """The transition from a state on a character: next state, change in the count."""
        if c not in self.score:  # its bytes; nothing merges with them
            return self._enter("", ((None, 0),)), len(c.encode())
        suffix, places = state.suffix, state.places
        for k in range(len(suffix) + 1):
            piece = suffix[len(suffix) - k :] + c
            last, count = places[k]
            if piece in self.score and self.fits(last, piece):
                break
        else:
            raise ValueError(f"no piece ends in {c!r}")
        gained = count + 1
        places = ((piece, 0), *((p, n - gained) for p, n in places))
        grown = suffix + c
        while grown and grown not in self.prefixes:
            grown = grown[1:]
        places = list(places[: len(grown) + 1])
        if grown.startswith(MARK) and places[-1][0] and not places[-1][0].endswith(MARK):
            places[-1] = (None, places[-1][1])  # what follows starts with a mark and fits always
        return self._enter(grown, tuple(places)), gained

    def _enter(self, suffix: str, places: tuple) -> Row:
        row = self.states.get((suffix, places))
        if row is None:
            row = self.states[suffix, places] = Row()
            row.suffix, row.places = suffix, places
        return row

    def run(self, text: str) -> int:
        state, total = self.start, 0
        for c in text:
            move = state.get(c)
            if move is None:
                move = state[c] = self.compile(state, c)
            state = move[0]
            total += move[1]
        return total

    def counts(self, normals: list[str]) -> list[int]:
        """Tokens of each normalised text, reset by reset. Words not met before are read in
        sorted order, which passes through the same states one after another."""
        cut = [_RESETS.findall(x) for x in normals]
        new = set().union(*cut).difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words.clear()
            new = set().union(*cut)
        for w in sorted(new):
            self.words[w] = self.run(w)
        return [sum(map(self.words.__getitem__, c)) for c in cut]

    def count(self, normal: str) -> int:
        return self.counts([normal])[0]


_RESETS = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
_RESET = re.compile(f"(?<=[^{MARK}]){MARK}")


@dataclass
class Map:
    """What a chunk does from any state: ``head`` and ``tail`` still to be read together with the
    neighbours' ends, ``inner`` tokens between. Without a reset all is head, and tail is None."""

    head: str
    inner: int = 0
    tail: str | None = None


def chunk_map(t: Transducer, chunk: str) -> Map:
    first = _RESET.search(chunk)
    if not first:
        return Map(chunk)
    # the last mark behind another character
    last = len(chunk)
    while not (chunk[last - 1] != MARK and last < len(chunk) and chunk[last] == MARK):
        last = chunk.rindex(MARK, 0, last)
    return Map(chunk[: first.start()], t.count(chunk[first.start() : last]), chunk[last:])


def compose(t: Transducer, a: Map, b: Map) -> Map:
    if a.tail is None and b.tail is None:
        return Map(a.head + b.head)
    if a.tail is None:
        return Map(a.head + b.head, b.inner, b.tail)
    if b.tail is None:
        return Map(a.head, a.inner, a.tail + b.head)
    return Map(a.head, a.inner + t.count(a.tail + b.head) + b.inner, b.tail)


def combined(t: Transducer, maps: list[Map]) -> int:
    """Tokens of the chunks in order: neighbours are composed until one map is left."""
    while len(maps) > 1:
        maps = [compose(t, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return t.count(maps[0].head) + maps[0].inner + t.count(maps[0].tail or "") if maps else 0


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            tokens = []
            for _, pack in packs(octets(batch.column("text")), PACK):
                tokens += t.counts([t.model.normalize(x.decode()) if x else "" for x in pack])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64())}
            )

    return run


def _map_chunks(path: str):
    """One row per chunk: its map. The first chunk of a text carries the mark put before a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            maps = []
            for part, x in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist()):
                normal = t.model.normalize(x)
                maps.append(chunk_map(t, normal if part == 0 else normal.removeprefix(MARK)))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("row", "doc_id", "n_bytes", "part")},
                "head": pa.array([m.head for m in maps], pa.string()), "inner": pa.array([m.inner for m in maps], pa.int64()),
                "tail": pa.array([m.tail for m in maps], pa.string()),
            })

    return run


def _combine(path: str):
    def run(table: pa.Table) -> pa.Table:
        t = transducer(path)
        table = table.sort_by("part")
        maps = [Map(*x) for x in zip(*(table.column(c).to_pylist() for c in ("head", "inner", "tail")))]
        one = table.slice(0, 1)
        return pa.table({
            "doc_id": one.column("doc_id"), "n_bytes": one.column("n_bytes"), "n_tokens": pa.array([combined(t, maps)], pa.int64()),
        })

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """Returns (doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id bigint, text).

    ``path``: a sentencepiece byte-pair model whose normalisation is by character, present on every
    machine. Counts are without begin and end tokens; strings that look like special tokens are ordinary
    text. Null and empty texts have 0 bytes and tokens. Rows are independent: repeated rows and null ids
    are returned as they come, other columns are ignored. Texts over ``chunk`` characters are cut;
    every character is read.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    long = F.length("text") > chunk
    out = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    short = source.where(~long).mapInArrow(_short(path), out)
    parts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    chunks = (
        source.where(long).withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "n_bytes", "text", F.explode(parts).alias("part"))
        .select("row", "doc_id", "n_bytes", "part", F.substr("text", F.col("part") * chunk + 1, F.lit(chunk)).alias("chunk"))
    )
    maps = chunks.repartition("row", "part").mapInArrow(
        _map_chunks(path), "row bigint, doc_id bigint, n_bytes bigint, part int, head string, inner bigint, tail string"
    )
    whole = maps.groupBy("row").applyInArrow(_combine(path), out)
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)
