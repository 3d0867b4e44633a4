"""Random columns. A draw is a digest of its seed and the row's key, so a table can be made again, in any
partitions, row by row or whole; equal keys draw equal values, so the key must name the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the constant added in every non-uniform draw.
NURAND_C = 128

#: Rounds of a shuffle; each moves half of the numbers.
SHUFFLE_ROUNDS = 32


def nurand(first: Column, second: Column, low: int, high: int) -> Column:
    """Non-uniform number in low..high from two uniform draws, 0..a and low..high."""
    return F.pmod(first.bitwiseOR(second) + NURAND_C, F.lit(high - low + 1)) + low


def _column(key: Column | str | int) -> Column:
    return F.col(key) if isinstance(key, str) else F.lit(key)


def _digest(seed: int, key: tuple) -> Column:
    if not key:
        raise ValueError("a draw needs the row's key")
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(_column(k).cast("string") for k in key)))


def unit(seed: int, *key: Column | str | int) -> Column:
    """Number in [0, 1): the first 52 bits of a digest of seed and key."""
    return F.conv(F.substring(_digest(seed, key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform(low: int, high: int, seed: int, *key: Column | str | int) -> Column:
    """Whole number in low..high, both included."""
    return (F.floor(unit(seed, *key) * (high - low + 1)) + low).cast("long")


def uniform_decimal(low: int, high: int, places: int, seed: int, *key: Column | str | int) -> Column:
    return (uniform(low, high, seed, *key).cast("decimal(18,0)") / F.lit(10**places)).cast(f"decimal(18,{places})")


def nurand_draw(a: int, low: int, high: int, seed: int, *key: Column | str | int) -> Column:
    return nurand(uniform(0, a, seed, *key), uniform(low, high, seed + 1, *key), low, high)


def chance(percent: float, seed: int, *key: Column | str | int) -> Column:
    return unit(seed, *key) * 100 < percent


def _characters(low: int, high: int, seed: int, key: tuple, one) -> Column:
    """low..high characters, each from 16 bits; a digest has eight of them. The digests stand in the only
    element of the outer array, so they are taken once a row and not once a character."""
    length = uniform(low, high, seed + 1, *key).cast("int")
    digests = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 8)), lambda n: _digest(seed, (*key, n)))
    rows = F.array(F.struct(F.array_join(digests, "").alias("hex"), F.sequence(F.lit(1), length).alias("at")))

    def spell(row):
        words = F.transform(row["at"], lambda i: one(F.conv(F.substr(row["hex"], i * 4 - 3, F.lit(4)), 16, 10).cast("int")))
        return F.array_join(words, "")

    return F.element_at(F.transform(rows, spell), 1)


def printable_text(low: int, high: int, seed: int, *key: Column | str | int) -> Column:
    """low..high printable ASCII characters (32..126)."""
    return _characters(low, high, seed, key, lambda word: F.char(word % 95 + 32))


def digits(low: int, high: int, seed: int, *key: Column | str | int) -> Column:
    return _characters(low, high, seed, key, lambda word: (word % 10).cast("string"))


def permuted(at: Column, n: Column, seed: int, *key: Column | str | int) -> Column:
    """Where ``at`` of 0..n-1 goes in a shuffled order of these numbers, without sorting them.

    A swap-or-not shuffle: each round pairs x with turn - x (mod n) and swaps the pair or not, as a draw
    for its larger member says, so each round is one-to-one for any n. The key is the shuffled group's.
    """
    rounds = F.transform(
        F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS)),
        lambda r: F.struct(r.alias("round"), F.floor(unit(seed, *key, r) * n).cast("long").alias("turn")),
    )

    def swap(x, step):
        other = F.pmod(step["turn"] - x, n)
        return F.when(unit(seed + 1, *key, step["round"], F.greatest(x, other)) < 0.5, other).otherwise(x)

    return F.aggregate(rounds, at.cast("long"), swap)


# Percent of each transaction type, in the order a draw is compared.
MIX = [("stocklevel", 4.2), ("orderstatus", 4.2), ("delivery", 4.2), ("payment", 43.2), ("neworder", 44.2)]


def transaction_type(draw: Column) -> Column:
    """The transaction type for a uniform draw in [0, 100)."""
    reached, out = 0.0, None
    for name, percent in MIX[:-1]:
        reached += percent
        test = draw < F.lit(round(reached, 6))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(MIX[-1][0])
