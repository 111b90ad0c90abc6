"""Nearest neighbours, fuzzy graphs and batch-balanced graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.frame import AnnFrame
from celerix.operators.blocks import ROWS, packed, rows_of, unpacked
from celerix.session import cut

FILE_BYTES = 1 << 25  # of points that one task searches


def _direct(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, added up dimension by dimension."""
    d = np.zeros(len(q))
    for j in range(q.shape[1]):
        d += (q[:, j] - p[:, j]) ** 2
    return d


class Nearest:
    """The k nearest of some queries by (distance, id), over blocks of points as they come.

    A product in single precision leaves out the points that are surely farther than the k found so far, by a bound on
    its error; the others are measured by direct differences.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, own: bool):
        self.q, self.q_ids, self.k, self.own = q, q_ids, k, own
        self.row, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.met, self.far = 0, np.full(len(q), np.inf)

    def meet(self, p: np.ndarray, p_ids: np.ndarray) -> None:
        at = 0
        while at < len(p):  # as many as were met before: so many more that few are nearer than the k found
            width = max(512, 4 * self.k, self.met)
            self._chunk(p[at : at + width], p_ids[at : at + width])
            at += width
            self.met += width

    def _chunk(self, p: np.ndarray, p_ids: np.ndarray) -> None:
        middle = p.mean(0)
        pc, dim = p - middle, p.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows is measured directly
            np_ = (pc**2).sum(1)
            e = 4 * (dim + 8) * 2.0**-24
            right = np.concatenate([pc, (np_ * (1 - e) / 2)[:, None]], axis=1).astype(np.float32).T.copy()
            rows = max(1, (1 << 23) // len(p))
            for lo in range(0, len(self.q), rows):
                qc = self.q[lo : lo + rows] - middle
                nq = (qc**2).sum(1)
                g = np.concatenate([qc, np.full((len(qc), 1), -1.0)], axis=1).astype(np.float32) @ right
                far = self.far[lo : lo + rows]
                open_ = np.flatnonzero(np.isinf(far))
                if len(open_) and len(p) > 2 * self.k:  # the k-th largest product bounds the k-th distance from above
                    kth = -np.partition(-g[open_], self.k, axis=1)[:, self.k]
                    loose = (nq[open_] - 2 * kth) + 2 * e * (nq[open_] + np_.max())
                    far = far.copy()
                    far[open_] = np.where(np.isfinite(loose), np.sqrt(np.maximum(loose, 0)), np.inf)
                least = (nq * (1 - e) - far**2 * (1 + 1e-12)) / 2
                least = np.nextafter((least - np.abs(least) * 1e-6).astype(np.float32), np.float32(-np.inf))
                near = ~(g < least[:, None])  # not a number counts as near
                per = near.sum(1)
                for a, b in _pieces(per, 1 << 19):
                    at = np.flatnonzero(near[a:b])
                    if len(at):
                        self._take(at // len(p) + a + lo, at % len(p), p, p_ids)

    def _take(self, row: np.ndarray, j: np.ndarray, p: np.ndarray, p_ids: np.ndarray) -> None:
        if not self.own:
            other = self.q_ids[row] != p_ids[j]
            row, j = row[other], j[other]
        d = np.concatenate([np.sqrt(_direct(self.q[row[lo : lo + 8192]], p[j[lo : lo + 8192]])) for lo in range(0, len(row), 8192)] or [np.zeros(0)])
        better = d <= self.far[row]
        row, ids, d = row[better], p_ids[j[better]], d[better]
        if not len(row):
            return
        touched = np.zeros(len(self.q), bool)
        touched[row] = True
        old = touched[self.row]
        r, i, x = np.concatenate([self.row[old], row]), np.concatenate([self.id[old], ids]), np.concatenate([self.d[old], d])
        order = np.lexsort((i, x, r))
        r, i, x = r[order], i[order], x[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        keep = place < self.k
        full = place == self.k - 1
        self.far[r[full]] = x[full]
        self.row, self.id, self.d = np.concatenate([self.row[~old], r[keep]]), np.concatenate([self.id[~old], i[keep]]), np.concatenate([self.d[~old], x[keep]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, distance), in order of row, distance and id."""
        order = np.lexsort((self.id, self.d, self.row))
        return self.row[order], self.id[order], self.d[order]


def _pieces(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts sum to about `most`, or that are of one place."""
    at, total = 0, np.concatenate([[0], np.cumsum(counts)])
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, end
        at = end


def _passed(met: DataFrame, k: int, include_self: bool) -> DataFrame:
    """obs_id, part, nbr_id, dist: candidates of blocks of queries (q_ids, q_vecs) that meet blocks of points (part, ids, vecs), k for each run of rows of a block of queries."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, parts = np.zeros(0, np.int64), None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for part, best in parts.items():
                at, ids, d = best.found()
                for lo in range(0, len(at), 1 << 16):
                    some = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(best.q_ids[at[some]]), pa.array([part] * len(at[some]), pa.string()), pa.array(ids[some]), pa.array(d[some])], ["obs_id", "part", "nbr_id", "dist"])

        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda c, r=r, batch=batch: batch.column(c)[r]
                now = unpacked(at("q_ids").as_buffer(), at("q_vecs").as_buffer())
                if q is None or not (np.array_equal(now[0], q_ids) and np.array_equal(now[1], q, equal_nan=True)):
                    yield from done()
                    (q_ids, q), parts = (x.copy() for x in now), {}
                part = at("part").as_py()
                if part not in parts:
                    parts[part] = Nearest(q, q_ids, k, include_self)
                p_ids, p = unpacked(at("ids").as_buffer(), at("vecs").as_buffer())
                parts[part].meet(p, p_ids)
        yield from done()

    return met.select("q_ids", "q_vecs", "part", "ids", "vecs").mapInArrow(nearest, "obs_id long, part string, nbr_id long, dist double")


def exact_knn(vecs: DataFrame, k: int, include_self: bool = False, by: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """obs_id, rank, nbr_id, dist[, part]: the k nearest by (distance, id), ranks from 1; by (obs_id, part): k in each part.

    Points are packed into blocks of at most about ROWS rows, FILE_BYTES of them a file. A task takes some blocks of
    queries past the blocks of a file, one after the other, and returns k candidates a query; a top-k merge ends it.
    Nothing but the candidates is shuffled, and a task holds a file of points and two blocks.
    """
    pts = vecs.select("obs_id", "vec").join(by, "obs_id") if by is not None else vecs.select("obs_id", "vec", F.lit("").alias("part"))
    first = vecs.select(F.size("vec")).first()
    n, width = max(1, pts.count()), 8 * (1 + (first[0] if first else 0))
    rows = min(ROWS, max(256, -(-n // 16)))
    points = packed(pts, rows, -(-n * width // FILE_BYTES))
    asked = vecs if queries is None else vecs.join(queries, "obs_id", "left_semi")
    asked = packed(asked.select("obs_id", "vec", F.lit("").alias("part")), rows)

    left = asked.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    met = left.hint("shuffle_replicate_nl").crossJoin(points.select("part", "ids", "vecs"))
    found = _passed(met, k, include_self)
    top = F.row_number().over(W.partitionBy("obs_id", "part").orderBy("dist", "nbr_id"))
    out = found.withColumn("rank", top).filter(F.col("rank") <= k)
    return out.select("obs_id", "rank", "nbr_id", "dist", "part") if by is not None else out.select("obs_id", "rank", "nbr_id", "dist")


IVF_DEAL = 8  # tasks that share the queries of a cell


def ivf_knn(vecs: DataFrame, k: int, nprobe: int = 5, seed: int = 0, include_self: bool = False) -> DataFrame:
    """Approximate k nearest: k-means cells of about 1500 rows; each row searches the nprobe cells nearest to it.

    Rows that search a cell and the cell's own rows are packed into blocks, which meet cell by cell.
    """
    from celerix.operators.clustering import kmeans_centres

    n = vecs.count()
    centres = kmeans_centres(vecs, max(2, n // 1500), seed=seed, max_iter=10)
    step = max(1, (1 << 22) // max(1, centres.size))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                d = ((rows_of(part.column("vec"))[:, None] - centres[None]) ** 2).sum(2)
                cells = np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype(str)
                yield pa.RecordBatch.from_arrays([part.column("obs_id"), part.column("vec"), pa.array(cells.tolist(), pa.list_(pa.string()))], ["obs_id", "vec", "cells"])

    kinds = dict(vecs.dtypes)
    cells = cut(vecs.select("obs_id", "vec").mapInArrow(near, f"obs_id {kinds['obs_id']}, vec {kinds['vec']}, cells array<string>"))
    rows = min(ROWS, max(256, -(-n // 16)))
    home = packed(cells.select("obs_id", "vec", F.col("cells")[0].alias("part")), rows)
    asked = packed(cells.select("obs_id", "vec", F.explode("cells").alias("part")), rows)
    asked = asked.select("part", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.pmod(F.xxhash64("ids"), F.lit(IVF_DEAL)).alias("deal"))
    met = asked.join(home.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(IVF_DEAL - 1)).cast("array<bigint>"))).hint("shuffle_hash"), ["part", "deal"])
    scored = _passed(met, k, include_self)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("obs_id").orderBy("dist", "nbr_id"))).filter(F.col("rank") <= k).select("obs_id", "rank", "nbr_id", "dist")


def nn_descent(vecs: DataFrame, k: int, iterations: int = 6, seed: int = 0) -> DataFrame:
    """Approximate k nearest: random lists improve by neighbours of neighbours, both ways, until few change."""
    n = vecs.count()
    width = min(2 * k, n - 1)
    ids = vecs.select("obs_id")
    # two partings into random cells that cross each other, so that neighbours of neighbours lead out of a cell
    slots = max(1, int(np.ceil(n / (width + 1))))
    pairs = None
    for turn in range(2):
        start = ids.withColumn("s", F.pmod(F.xxhash64("obs_id", F.lit(2 * seed + turn)), F.lit(slots)))
        met = start.join(start.toDF("nbr_id", "s"), "s").filter("obs_id <> nbr_id").select("obs_id", "nbr_id")
        pairs = met if pairs is None else pairs.union(met)
    left, right = vecs.toDF("obs_id", "v"), vecs.toDF("nbr_id", "w")
    dist = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))

    def best(p: DataFrame) -> DataFrame:
        scored = p.distinct().join(left, "obs_id").join(right, "nbr_id").select("obs_id", "nbr_id", dist.alias("dist"))
        return cut(scored.withColumn("rank", F.row_number().over(W.partitionBy("obs_id").orderBy("dist", "nbr_id"))).filter(F.col("rank") <= width))

    lists = best(pairs)
    for _ in range(iterations):
        edges = lists.select("obs_id", "nbr_id")
        both = edges.union(edges.select("nbr_id", "obs_id")).distinct().withColumn("r", F.row_number().over(W.partitionBy("obs_id").orderBy(F.xxhash64("nbr_id", F.lit(seed))))).filter(F.col("r") <= 2 * width).drop("r")
        two = both.join(both.select(F.col("obs_id").alias("nbr_id"), F.col("nbr_id").alias("far")), "nbr_id").filter("obs_id <> far").select("obs_id", F.col("far").alias("nbr_id"))
        new = best(edges.union(two))
        changed = new.join(lists.select("obs_id", "nbr_id"), ["obs_id", "nbr_id"], "left_anti").filter(F.col("rank") <= k).count()
        lists = new
        if changed <= 0.001 * n * k:
            break
    return lists.filter(F.col("rank") <= k).select("obs_id", "rank", "nbr_id", "dist")


def knn(vecs: DataFrame, k: int, approx: bool | None = None, backend: str = "nndescent", seed: int = 0) -> DataFrame:
    """Exact, whatever the number of rows; with approx by backend `nndescent` or `ivf`. Self is excluded; k is at most n - 1."""
    k = min(k, max(1, vecs.count() - 1))
    if not approx:
        return exact_knn(vecs, k)
    if backend not in ("nndescent", "ivf"):
        raise ValueError("backend is nndescent or ivf")
    return nn_descent(vecs, k, seed=seed) if backend == "nndescent" else ivf_knn(vecs, k, seed=seed)


def _smooth(d: np.ndarray, goal: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of d: rho, the least positive distance, and sigma with sum exp(-max(0, d - rho) / sigma) = goal, by bisection."""
    rho = np.where(d > 0, d, np.inf).min(1, initial=np.inf)
    rho[np.isinf(rho)] = 0.0
    lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    over, live = np.maximum(0, d - rho[:, None]), np.arange(len(d))
    for _ in range(64):
        total = np.exp(-over[live] / sigma[live, None]).sum(1)
        open_ = np.abs(total - goal) >= 1e-5
        live, up = live[open_], total[open_] > goal
        if not len(live):
            break
        a, b = live[up], live[~up]
        hi[a] = sigma[a]
        sigma[a] = (lo[a] + sigma[a]) / 2
        lo[b] = sigma[b]
        sigma[b] = np.where(np.isinf(hi[b]), sigma[b] * 2, (sigma[b] + hi[b]) / 2)
    mean = d.mean(1) if d.shape[1] else np.zeros(len(d))
    return rho, np.maximum(sigma, np.where(mean > 0, 1e-3 * mean, 1e-12))


def fuzzy_weights(found: DataFrame, k: int) -> DataFrame:
    """src, dst, weight: directed membership of each neighbour; k counts self, so the goal is log2 k."""
    lists = found.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr_id"))).alias("near"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, size = batch.column("near").flatten(), np.diff(batch.column("near").offsets.to_numpy())
            d, dst, src = near.field(0).to_numpy(), near.field(1).to_numpy(), np.repeat(batch.column("obs_id").to_numpy(), size)
            weight, start = np.zeros(len(d)), np.cumsum(size) - size
            for width in np.unique(size[size > 0]).tolist():
                at = start[size == width][:, None] + np.arange(width)
                rho, sigma = _smooth(d[at], np.log2(k))
                weight[at] = np.exp(-np.maximum(0, d[at] - rho[:, None]) / sigma[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(weight)], ["src", "dst", "weight"])

    return lists.mapInArrow(weigh, "src long, dst long, weight double")


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """A + A' - A o A'."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("b"))
    both = edges.join(back, ["src", "dst"], "full").fillna(0.0, ["weight", "b"])
    return both.select("src", "dst", (F.col("weight") + F.col("b") - F.col("weight") * F.col("b")).alias("weight")).filter("weight > 0")


def choose_representation(frame: AnnFrame, use_rep: str | None = None, n_pcs: int | None = None) -> DataFrame:
    """Vectors to search: use_rep, else X_pca, else PCA(50) of more than 50 columns, else the rows of x."""
    if use_rep is not None and use_rep != "X":
        vecs = frame.obsm[use_rep]
    elif use_rep is None and "X_pca" in frame.obsm:
        vecs = frame.obsm["X_pca"]
    elif use_rep is None and frame.n_vars > 50:
        from celerix.operators.decomposition import pca

        vecs = pca(frame, n_comps=min(50, frame.n_vars - 1)).obsm["X_pca"]
    else:
        from celerix.operators.decomposition import dense_rows

        vecs = dense_rows(frame)[0]
    return vecs.select("obs_id", (F.slice("vec", 1, n_pcs) if n_pcs else F.col("vec")).alias("vec"))


def neighbors(frame: AnnFrame, n_neighbors: int = 15, n_pcs: int | None = None, use_rep: str | None = None, metric: str = "euclidean", key_added: str | None = None, random_state: int = 0, approx: bool | None = None) -> AnnFrame:
    """obsp distances (n_neighbors - 1 a row) and connectivities."""
    if metric != "euclidean":
        raise NotImplementedError("metric is euclidean")
    found = cut(knn(choose_representation(frame, use_rep, n_pcs), n_neighbors - 1, approx, seed=random_state))
    pre = f"{key_added}_" if key_added else ""
    distances = found.select(F.col("obs_id").alias("src"), F.col("nbr_id").alias("dst"), F.col("dist").alias("weight"))
    out = frame.with_obsp(f"{pre}distances", distances).with_obsp(f"{pre}connectivities", cut(fuzzy_union(fuzzy_weights(found, n_neighbors))))
    params = {"connectivities_key": f"{pre}connectivities", "distances_key": f"{pre}distances", "params": {"n_neighbors": n_neighbors, "metric": metric, "random_state": random_state}}
    return out.with_uns(**{key_added or "neighbors": params})


def connectivities(frame: AnnFrame, neighbors_key: str | None = None) -> DataFrame:
    key = neighbors_key or "neighbors"
    if key not in frame.uns:
        raise KeyError(f"run neighbors first: uns has no {key}")
    return frame.obsp[frame.uns[key]["connectivities_key"]]


def trim(edges: DataFrame, most: int) -> DataFrame:
    """Edges at least as heavy as the most-th heaviest of their source, then of their target."""
    out = edges
    for side in ("src", "dst"):
        heavy = out.withColumn("_r", F.row_number().over(W.partitionBy(side).orderBy(F.desc("weight")))).filter(F.col("_r") == most).select(side, F.col("weight").alias("_t"))
        out = out.join(heavy, side, "left").filter(F.col("_t").isNull() | (F.col("weight") >= F.col("_t"))).select("src", "dst", "weight")
    return out


def batch_label(frame: AnnFrame, keys: str | list[str]) -> DataFrame:
    """obs_id, part: one label of several columns, joined by |."""
    return frame.obs.select("obs_id", F.concat_ws("|", *[F.col(k).cast("string") for k in ([keys] if isinstance(keys, str) else keys)]).alias("part"))


def bbknn(frame: AnnFrame, batch_key: str | list[str], neighbors_within_batch: int = 3, n_pcs: int = 50, use_rep: str | None = None, trim_to: int | None = None) -> AnnFrame:
    """neighbors, with neighbors_within_batch from each batch (self among its own)."""
    batches = batch_label(frame, batch_key)
    width = neighbors_within_batch * batches.select("part").distinct().count()
    found = cut(exact_knn(choose_representation(frame, use_rep, n_pcs), neighbors_within_batch, True, by=batches).filter("obs_id <> nbr_id"))
    distances = found.select(F.col("obs_id").alias("src"), F.col("nbr_id").alias("dst"), F.col("dist").alias("weight"))
    graph = trim(fuzzy_union(fuzzy_weights(found, width)), 10 * width if trim_to is None else trim_to)
    params = {"connectivities_key": "connectivities", "distances_key": "distances", "params": {"n_neighbors": width, "metric": "euclidean"}}
    return frame.with_obsp("distances", distances).with_obsp("connectivities", cut(graph)).with_uns(neighbors=params)


def ilisi(vecs: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """obs_id, lisi: inverse Simpson index of the batch labels among the k nearest."""
    near = exact_knn(vecs, k).join(batches.toDF("nbr_id", "b"), "nbr_id").groupBy("obs_id", "b").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("obs_id"))
    return near.withColumn("p", share).groupBy("obs_id").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))


__all__ = ["bbknn", "connectivities", "exact_knn", "fuzzy_union", "fuzzy_weights", "ilisi", "ivf_knn", "knn", "neighbors", "nn_descent", "trim"]
