"""Vectors in blocks: rows of the shared folder that hold thousands of vectors as bytes, and sums over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.session import cut

ROWS = 4096  # of a block
SUM_BYTES = 1 << 20  # of sums that each partition sends to the driver at most; larger ones are added on the executors


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


def binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())


def packed(pts: DataFrame, rows: int, files: int | None = None) -> DataFrame:
    """part, ids, vecs: points (obs_id, vec, part) in blocks of about `rows` of one part, as bytes, in the shared folder."""
    n = max(1, pts.count())
    slots = -(-n // rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            x, ids = rows_of(batch.column("vec")), batch.column("obs_id").to_numpy()
            parts = batch.column("part").dictionary_encode()
            of, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
            for c, name in enumerate(names):
                mine = np.flatnonzero(of == c)
                held.setdefault(name, []).append((ids[mine], x[mine]))
                size = sum(len(h[0]) for h in held[name])
                if size >= 2 * rows:
                    yield block(name, held.pop(name))
        for name, some in held.items():
            yield block(name, some)

    def block(name: str, some: list) -> pa.RecordBatch:
        ids, x = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), binary([ids[order]]), binary([x[order]])], ["part", "ids", "vecs"])

    sizes = pts.groupBy("part").agg(F.ceil(F.count("*") / rows).alias("_slots"))
    dealt = pts.join(F.broadcast(sizes), "part").select("obs_id", "vec", "part", F.pmod(F.xxhash64("obs_id"), "_slots").alias("_slot"))  # one row a part
    blocks = dealt.repartition(slots, "part", "_slot").mapInArrow(pack, "part string, ids binary, vecs binary")
    return cut(blocks if files is None else blocks.coalesce(max(1, min(slots, files))))


def unpacked(ids, vecs) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs, float).reshape(len(i), -1)


def vector_blocks(vecs: DataFrame, *columns: str) -> DataFrame:
    """ids, vecs and the named whole-number columns of vecs (obs_id, vec, ...) as bytes, where the rows are, in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                whole = [part.column(c).to_numpy().astype(np.int64) for c in ("obs_id", *columns)]
                yield pa.RecordBatch.from_arrays([binary([v]) for v in whole] + [binary([rows_of(part.column("vec"))])], ["ids", *columns, "vecs"])

    return cut(vecs.select("obs_id", "vec", *columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in ("ids", *columns, "vecs"))))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(vecs, ids, other columns) of blocks."""
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("ids", "vecs")]
        for r in range(batch.num_rows):
            ids, x = unpacked(batch.column("ids")[r].as_buffer(), batch.column("vecs")[r].as_buffer())
            if len(ids):
                yield (x, ids, *(np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in names))


def summed(blocks: DataFrame, partial: Callable[[Iterator[tuple[np.ndarray, ...]]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all partitions of the array of this shape that partial makes of a partition's blocks."""
    size = int(np.prod(shape))
    step = SUM_BYTES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = partial(each_block(batches)).ravel()
        for lo in range(0, size, step):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), binary([flat[lo : lo + step]])], ["at", "s"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in t.column("s"))
        return pa.table({"at": t.column("at").slice(0, 1), "s": binary([total])})

    parts = blocks.mapInArrow(run, "at long, s binary")
    if size > step:
        parts = parts.groupBy("at").applyInArrow(add, "at long, s binary")
    total = np.zeros(size)
    for r in parts.collect():
        total[r["at"] : r["at"] + step] += np.frombuffer(r["s"])
    return total.reshape(shape)
