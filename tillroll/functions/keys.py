"""Transaction ids, partition numbers and the big-endian binary record keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_WORD = 0xFFFFFFFF

# Bytes per field of each record key, in order.
KEY_LAYOUTS = {
    "accepted": [8, 4],
    "modification": [8, 2],
    "result": [8, 1],
    "warehouse": [4, 4],
    "district": [4, 4, 4],
}
# Fixed value: modification keys are padded to this many bytes.
PADDED = {"modification": 12}


def pack_txn(serial: Column, connection: Column) -> Column:
    """Serial and connection, 32 bits each, in one long. A value that does not fit raises: cut off,
    two transactions would share an id."""
    low, top = -(1 << 31), (1 << 31) - 1
    fits = serial.between(low, top) & connection.between(low, top)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("transaction id out of range:"), serial.cast("string"), connection.cast("string")))
    high = F.shiftleft(serial.cast("long"), 32)
    packed = high.bitwiseOR(connection.cast("long").bitwiseAND(F.lit(LOW_WORD)))
    return F.when(serial.isNull() | connection.isNull(), F.lit(None).cast("long")).when(fits, packed).otherwise(wrong)


def connection_of(number: Column, connections: int) -> tuple[Column, Column]:
    """Serial and connection of transaction ``number`` (0, 1, 2, ...), dealt to ``connections`` clients in turn.

    A connection has 2^31 numbers to give; when they are used up, a client opens another one, so that
    serials fit their 32 bits however long the log is.
    """
    opened = F.shiftright(number.cast("long"), 31)
    serial = number.cast("long").bitwiseAND(F.lit((1 << 31) - 1))
    return serial, F.pmod(number.cast("long"), F.lit(connections)) + opened * connections


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def txn_serial(txn: Column) -> Column:
    return F.shiftright(txn, 32).cast("int")


def txn_connection(txn: Column) -> Column:
    return _signed(txn.bitwiseAND(F.lit(LOW_WORD)), 32).cast("int")


def partition_of(key: Column, partitions: int) -> Column:
    return F.pmod(key, F.lit(partitions))


def encode_key(layout: str, *fields: Column) -> Column:
    """Big-endian bytes of the fields, zero-padded where the layout asks for it."""
    widths = KEY_LAYOUTS[layout]
    digits = [
        F.right(F.lpad(F.hex(f.cast("long")), 16, "0"), F.lit(2 * width))
        for f, width in zip(fields, widths, strict=True)
    ]
    text = F.concat(*digits)
    if layout in PADDED:
        text = F.rpad(text, 2 * PADDED[layout], "0")
    return F.unhex(text)


def decode_key(layout: str, data: Column) -> list[Column]:
    """The fields of a binary key, each as a signed long."""
    digits = F.hex(data)
    out, start = [], 1
    for width in KEY_LAYOUTS[layout]:
        word = F.substring(digits, start, 2 * width)
        value = F.conv(word, 16, -10).cast("long")
        out.append(value if width == 8 else _signed(value, 8 * width).cast("long"))
        start += 2 * width
    return out
