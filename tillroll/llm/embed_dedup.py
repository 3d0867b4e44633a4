"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors of one label are compared in tiles of two blocks. Each unit vector is quantised to int8 with a scale of its
own, and the length of what quantisation took away is kept. For unit vectors x, y with quantised
forms a, b and losses e, f,  |x.y - a.b| <= e + f + 3 e f;  so only pairs whose tile product comes within that
bound of the threshold can link, and those are computed in double precision. Products of int8 in float32 are
exact up to 1040 dimensions; beyond that they are taken in float64.

Equal vectors of a label are one node with a multiplicity. A tile returns link counts and a spanning forest of its
links, never the pairs, so a large family costs its tiles' arithmetic but no more rows than vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import graph
from tillroll.session import settle

#: Vectors of a block, about.
BLOCK = 2048
EXACT_DIMS = (1 << 24) // (127 * 127)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's components as doubles, where it can link; else null."""
    for batch in batches:
        column = batch.column("embedding")
        out = []
        for ok, v in zip(batch.column("ok").to_pylist(), column):
            values = v.values if ok and v.is_valid else None
            if values is None or not len(values) or values.null_count:
                out.append(None)
                continue
            x = values.to_numpy(zero_copy_only=False).astype("<f8")
            # + 0.0: minus zero is zero
            out.append((x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_pydict(
            {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vec": pa.array(out, pa.binary())}
        )


def _block(table: pa.Table) -> pa.Table:
    """One row for a block: ids, multiplicities, the vectors, and their quantised forms."""
    ids, vecs = table.column("id").to_pylist(), table.column("vec").to_pylist()
    x = np.frombuffer(b"".join(vecs), dtype="<f8").reshape(len(ids), -1)
    u = x / _norms(x)[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    lost = np.linalg.norm(u - q * scale[:, None], axis=1) + 1e-12
    one = table.slice(0, 1)
    return pa.table({
        **{c: one.column(c) for c in ("label", "dim", "block", "blocks")},
        "ids": pa.array([ids], pa.list_(pa.int64())), "copies": pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())),
        "vecs": pa.array([x.tobytes()], pa.binary()), "q": pa.array([q.astype(np.int8).tobytes()], pa.binary()),
        "scale": pa.array([scale.tolist()], pa.list_(pa.float64())), "lost": pa.array([lost.tolist()], pa.list_(pa.float64())),
    })


def _norms(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large and very small components neither overflow nor vanish
    top = np.abs(x).max(axis=1)
    return np.linalg.norm(x / top[:, None], axis=1) * top


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x / _norms(x)[:, None], y / _norms(y)[:, None])


def linked(a: dict, b: dict, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks whose cosine reaches the threshold; the product tells which to compute."""
    kind = np.float32 if dim <= EXACT_DIMS else np.float64
    qa, qb = (np.frombuffer(t["q"], dtype=np.int8).reshape(-1, dim).astype(kind) for t in (a, b))
    xa, xb = (np.frombuffer(t["vecs"], dtype="<f8").reshape(-1, dim) for t in (a, b))
    (sa, ea), (sb, eb) = ((np.array(t["scale"]), np.array(t["lost"])) for t in (a, b))
    left, right = [], []
    step = max(1, (1 << 20) // len(xb))
    for i in range(0, len(xa), step):
        part = slice(i, i + step)
        product = (qa[part] @ qb.T).astype(np.float64) * sa[part, None] * sb
        bound = ea[part, None] + eb + 3 * ea[part, None] * eb + 1e-9
        rows, cols = np.nonzero(product + bound >= threshold)
        for k in range(0, len(rows), 1 << 16):
            r, c = rows[k : k + (1 << 16)] + i, cols[k : k + (1 << 16)]
            sure = cosines(xa[r], xb[c]) >= threshold
            left.append(r[sure])
            right.append(c[sure])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that links lead to."""
    to = np.arange(n)
    while True:
        low = np.minimum(to[left], to[right])
        new = to.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, to[left], low)
        np.minimum.at(new, to[right], low)
        new = new[new]
        if (new == to).all():
            return to
        to = new


def _tile(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, same = row["a"], row["b"], row["a"]["block"] == row["b"]["block"]
                i, j = linked(a, b, row["a"]["dim"], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                ids = np.array(a["ids"] + ([] if same else b["ids"]), dtype=np.int64)
                copies = np.array(a["copies"] + ([] if same else b["copies"]), dtype=np.int64)
                j = j if same else j + len(a["ids"])
                links = np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
                # smallest id first, so that the forest hangs from it
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(ids))
                to = ids[order][forest(len(ids), place[i], place[j])][place]
                has = links > 0
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[has]), "links": pa.array(links[has].astype(np.int64)), "to": pa.array(to[has]),
                })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """Returns (vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id bigint, embedding
    array of floats or doubles, label).

    Rows link when their labels are equal and not null, their dimensions are equal, and the cosine in double
    precision is at least ``threshold``. n_links: other rows linked directly; component_id: the smallest vec_id
    reachable; kept: whether that is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do rows without vec_id (component_id null, kept). Equal rows
    link with each other; rows that share an id are one node, their links added. Other columns are
    ignored; an empty table gives no rows.
    """
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", ok.alias("ok"))
    label = vectors.schema["label"].dataType.simpleString()
    rows = settle(
        rows.mapInArrow(_encode, f"vec_id bigint, label {label}, vec binary")
        .withColumn("key", F.sha2(F.concat_ws(" ", F.col("label").cast("string"), F.base64("vec")), 256))
    )
    nodes = (
        rows.where("vec is not null").groupBy("key").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"),
        ).withColumn("dim", (F.length("vec") / 8).cast("int"))
    )
    nodes = settle(nodes)
    at = ["label", "dim"]
    counts = nodes.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = nodes.join(counts, at).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    kind = (
        f"label {label}, dim int, block int, blocks int, ids array<bigint>, copies array<bigint>, vecs binary, q binary, "
        "scale array<double>, lost array<double>"
    )
    blocks = settle(dealt.select(*at, "block", "blocks", "id", "copies", "vec").groupBy(*at, "block").applyInArrow(_block, kind))
    whole = F.struct(*[c for c in blocks.columns if c != "label"])
    left = blocks.select(*at, F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), whole.alias("a"))
    right = blocks.select(*at, F.col("block").alias("other"), whole.alias("b"))
    tiles = left.join(right, [*at, "other"]).select("a", "b")
    found = settle(tiles.mapInArrow(_tile(threshold), "id bigint, links bigint, to bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = graph.components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    placed = (
        nodes.select("key", "id", "copies").join(links, "id", "left")
        .join(groups, F.col("id") == F.col("node"), "left")
        .select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
    )
    out = rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("key")).alias("key")).join(placed, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
