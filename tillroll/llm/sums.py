"""Sums of fixed-length count arrays that tasks fill: hashed counts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENTS = 16
SCHEMA = "segment int, counts binary"


def segments(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """An int64 or int32 array as SEGMENTS rows of SCHEMA; its length is a multiple of SEGMENTS."""
    return list(range(SEGMENTS)), [p.astype("<i8").tobytes() for p in np.split(counts, SEGMENTS)]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(c, dtype="<i8")
            if s in total:
                total[s] += part
            else:
                total[s] = part.copy()
    yield pa.RecordBatch.from_pydict(
        {"segment": pa.array(list(total), pa.int32()), "counts": pa.array([t.tobytes() for t in total.values()], pa.binary())}
    )


def total(parts: DataFrame, length: int) -> np.ndarray:
    """The sum over all rows, of fixed length, on the driver. Added up in two levels, each task
    holding no more than its segments, however many rows come in."""
    few = parts.select("segment", "counts").mapInArrow(_add, SCHEMA)
    rows = few.repartition(SEGMENTS, "segment").mapInArrow(_add, SCHEMA).collect()
    out = np.zeros(length, dtype=np.int64)
    for r in rows:
        part = np.frombuffer(r["counts"], dtype="<i8")
        out[r["segment"] * len(part) : (r["segment"] + 1) * len(part)] += part
    return out
