"""Words, n-grams and their 64-bit hashes for many texts at once, in numpy.

Used inside Arrow batches: a batch is cut into packs of a bounded number of bytes, a
pack's texts are laid end to end, and words are found and hashed by array operations.
Hashes are not random per process, so tasks can be repeated anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PACK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# after lower-casing: digits, a-z and every byte of a non-ASCII character
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# everything but space and the control characters tab to carriage return
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def octets(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def packs(texts: list[bytes | None], limit: int = PACK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about ``limit`` bytes each; null is empty."""
    first, size, pack = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if pack and size + len(t) > limit:
            yield first, pack
            first, size, pack = i, 0, []
        pack.append(t)
        size += len(t)
    if pack:
        yield first, pack


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased in one array, a space after each and padding behind the last;
    and where each starts (with one entry more, the end)."""
    joined = b" ".join(texts) + b" " * 9
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return LOWER[np.frombuffer(joined, dtype=np.uint8)], np.concatenate([[0], np.cumsum(sizes)])


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as one number."""
    return np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    view = eight(buf)
    h = sizes.astype(np.uint64) * _K
    live, at, left = np.arange(len(starts)), starts, sizes
    while len(live):
        h[live] = mix((h[live] ^ (view[at] & _MASK[np.minimum(left, 8)])) + _K)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order; and where each text's words start (one entry more)."""
    buf, bounds = lay(texts)
    inside = is_word[buf].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    return hash_spans(buf, starts, ends - starts), np.searchsorted(starts, bounds)


def fold(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence, whatever its length."""
    with np.errstate(over="ignore"):
        h = np.array([len(hashes)], dtype=np.uint64) * _K
        for x in hashes:
            h = mix(h * _K + x)
    return h[0]


def shingle_sets(texts: list[bytes], size: int, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles; with fewer words, the
    whole sequence as one; without words, none."""
    h, at = words(texts, is_word)
    rolled = mix(h)
    for j in range(1, size):
        if len(h) > j:
            rolled = mix(rolled[: len(h) - j] * _K + h[j:])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(np.array([fold(h[a:b])], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
