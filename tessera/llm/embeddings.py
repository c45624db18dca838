"""Near-duplicate embeddings by int8 tile products with error bounds for each vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spanning, stage, tune

#: Distinct vectors of one block; a tile is a pair of blocks.
BLOCK = 2048
#: Rows of a tile that are compared at a time.
STRIP = 256


class Side:
    """Unit vectors of a block, their int8 form and a bound on its error.

    x = s q + e with q of integers within 127. |x.y - s_x s_y q_x.q_y| is at most
    |e_x| + (1 + |e_x|) |e_y| for unit x and y; the norms are taken in double precision.
    """

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.unit = vectors / norm[:, None]
        self.scale = np.abs(self.unit).max(1) / 127
        q = np.rint(self.unit / self.scale[:, None])
        self.error = np.sqrt(((self.unit - q * self.scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
        self.q = q.astype(np.int8)

    def product(self, rows: slice, other: Side) -> np.ndarray:
        """Integer products; a float product of integers below its mantissa is exact."""
        kind = np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return self.q[rows].astype(kind) @ other.q.astype(kind).T


def pairs(a: Side, b: Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of all pairs whose cosine is at least the threshold, strip by strip."""
    for s in range(0, len(a.ids), STRIP):
        rows = slice(s, min(s + STRIP, len(a.ids)))
        near = a.product(rows, b) * a.scale[rows, None] * b.scale[None, :]
        bound = a.error[rows, None] + (1 + a.error[rows, None]) * b.error[None, :]
        i, j = np.nonzero(near + bound >= threshold)
        if same:
            i, j = i[j > i + s], j[j > i + s]
        if len(i) * 8 > near.size:
            exact = (a.unit[rows] @ b.unit.T)[i, j]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", a.unit[i[k : k + 65_536] + s], b.unit[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)] or [np.empty(0)])
        hit = exact >= threshold
        yield i[hit] + s, j[hit]


def _tile(threshold: float):
    names, kinds = ["a", "b", "n"], [pa.int64()] * 3

    def run(t: pa.Table) -> pa.Table:
        """Rows (a, null, n): class a has n links in this tile; (a, b, null): links that span the tile's groups."""
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        block = np.asarray(t.column("block"))
        order = np.argsort(block, kind="stable")
        cut = int((block == lo).sum())
        dim = t.column("dim")[0].as_py()
        vectors = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(-1, dim)
        ids, copies = np.asarray(t.column("cid")), np.asarray(t.column("copies"))
        sides = [Side(ids[k], copies[k], vectors[k]) for k in ((order[:cut], order[cut:]) if lo != hi else (order,)) if len(k)]
        if lo != hi and len(sides) < 2:
            return pa.table([pa.array([], k) for k in kinds], names)
        a, b = sides[0], sides[-1]
        shift = 0 if lo == hi else len(a.ids)
        label = np.arange(len(a.ids) + (len(b.ids) if shift else 0))
        of_a, of_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        spans: list[tuple[int, int]] = []
        for i, j in pairs(a, b, threshold, lo == hi):
            np.add.at(of_a, i, b.copies[j])
            np.add.at(of_b, j, a.copies[i])
            spans += spanning(label, i, j + shift)
        if lo == hi:
            counts, every = of_a + of_b, a.ids
        else:
            counts, every = np.concatenate((of_a, of_b)), np.concatenate((a.ids, b.ids))
        hit = np.flatnonzero(counts)
        from_, to = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
        pad = np.zeros(len(hit), np.int64)
        return pa.table([
            pa.array(np.concatenate((every[hit], every[from_] if spans else pad[:0]))),
            pa.array(np.concatenate((pad, every[to] if spans else pad[:0])), mask=np.arange(len(hit) + len(spans)) < len(hit)),
            pa.array(np.concatenate((counts[hit], np.zeros(len(spans), np.int64))), mask=np.arange(len(hit) + len(spans)) >= len(hit)),
        ], names)

    return run


def _usable(b: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes of doubles; null where a vector links with nothing."""
    out, dims = [], []
    column = b.column(1)
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = np.asarray(v.values, np.float64) + 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                n = float(x @ x)
            if not np.isfinite(n) or n == 0:
                # Very large or small components: the direction is what counts.
                top = np.abs(x).max()
                x = x / top if np.isfinite(x).all() and top > 0 else None
        out.append(None if x is None else x.tobytes())
        dims.append(0 if x is None else len(x))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["key", "label", "vec", "dim"])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for each row: links at a cosine of at least threshold between rows of one label.

    Labels that are null, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; vectors of different lengths do not link. Copies are
    one class: equal vectors of a label are compared once and count as often as they occur
    (they link with each other). component_id: the least key reachable, itself included;
    null keys never win. kept: key = component_id. One row for each input row.

    The classes of a label are dealt over blocks of about `block`, and each pair of blocks
    is one task, so a hot label is many equal tasks. Comparing within a label takes
    the square of its classes; only the products are that many: a tile returns counts and
    the links that span its groups. A class is sent once for each block of its label.
    """
    tune(df.sparkSession)
    src = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_usable, batches)

    rows = stage(src.mapInArrow(run, "key long, label string, vec binary, dim int").withColumn("usable", F.expr("vec is not null and label is not null")), "vectors")
    of_class = rows.where("usable").groupBy("label", "dim", "vec").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    classes = stage(of_class.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    tiles = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    found = tiles.select("label", "dim", "lo", "hi", "block", "cid", "copies", "vec").groupBy("label", "dim", "lo", "hi").applyInArrow(_tile(threshold), "a long, b long, n long")
    found = stage(found, "tiles")
    linked = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    cc = components(found.where("b is not null"))
    rooted = classes.select("cid", "least").join(cc, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(of_root, "root").join(linked, "cid", "left").select("cid", "component", F.coalesce("n", F.lit(0)).alias("n"))
    full = classes.select("label", "dim", "vec", "cid", "copies").join(named, "cid").select("label", "dim", "vec", "component", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    out = rows.where("usable").join(full, ["label", "dim", "vec"]).select("key", "n_links", "component")
    alone = rows.where("not usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    both = out.unionByName(alone)
    return both.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
