"""Mixing sources to target weights by entropy balancing.

Targets: every source has a weight and gets that share of all words, at most `most` times its own words; what is above
is shared again by weight among the others. The rates are those of least relative entropy, measured over words, that
meet the token constraints: exp of a sum of multipliers, one for each constraint that a document takes part in. There
is a constraint for each source, its target, and one for each size band (documents of 2^k to 2^(k+1) words): as far as
the sources allow, the mix keeps the share of the words that the band has in the corpus. So the documents of a source
have rates that differ by size. The convex dual is solved by Newton steps over the documents' sums by source and band;
the bands' multipliers are damped (RIDGE), since their constraints may contradict the sources', which hold exactly.
Where a rate would pass `most` it stops there and its source's other rates rise. Rates become whole copies by
systematic rounding along each source's documents in order of size, and a last pass moves a few documents by one copy
to close what is left.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 times; a source without words has target 0; empty tables give empty results; repeated rows are separate
documents; other columns are ignored, of any name; texts of any length count whole. Every choice follows a hash of (doc_id, text), so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.llm.common import bounded, lean, pieces, stored, text_bytes

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
PER_SALT = 5_000  # documents ranked by one task at once
RIDGE = 0.05  # damping of the bands' multipliers, as a share of the band's words


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, draw and size of every row; size is the number of [^\\x20\\x09-\\x0D]+ in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                size = pa.array([len(raw.split()) for raw in text_bytes(part.column("text"))], pa.int64())  # bytes.split() parts at these six bytes
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "text_hash", "draw")), size], ["doc_id", "source", "text_hash", "draw", "size"])

    text = F.col("text").cast("string")
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.withColumn("draw", F.xxhash64("doc_id", "text_hash", F.lit(9))).mapInArrow(lean(run), "doc_id long, source string, text_hash long, draw long, size long")


def targets_of(sizes: list[float], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight; a source stops at most * size, and the excess goes to the others by weight until none is above."""
    out, free = [0.0] * len(sizes), [k for k in range(len(sizes)) if weights[k] > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[k] for k in free)
        full = [k for k in free if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free = [k for k in free if k not in full]
    return out


def solve_dual(cells: DataFrame, keys: list[str], targets: list[dict], steps: int = 50, tolerance: float = 1e-10, ridge: tuple[float, ...] = ()) -> list[dict]:
    """Multipliers by key and value, such that over cells (keys..., words) the sum of words * exp(sum of multipliers) meets every target.

    cells holds one row for each combination of key values; a step aggregates it to the gradient (one sum for each
    value) and the Hessian (one for each pair of values that meet), which are as large as the set of constraints is.
    A target of 0 has the multiplier -inf. ridge gives each key's damping: a multiplier of m moves its target by ridge * target * m.
    """
    spark = cells.sparkSession
    names = [(k, v) for k, t in enumerate(targets) for v in sorted(t, key=lambda x: (x is None, x)) if t[v] > 0]
    at = {x: i for i, x in enumerate(names)}
    goal = np.array([targets[k][v] for k, v in names], float)
    damp = np.array([ridge[k] * targets[k][v] if ridge else 0.0 for k, v in names], float)
    lam = np.zeros(len(names))
    value, drop = math.inf, {(k, v) for k, t in enumerate(targets) for v in t if t[v] <= 0}
    rows = cells
    for k, v in drop:
        rows = rows.filter(~F.col(keys[k]).eqNullSafe(F.lit(v)))
    move = np.zeros(len(names))
    for _ in range(steps):
        rate = F.lit(1.0) * F.col("words")
        frame = rows
        for k, key in enumerate(keys):
            table = [(v, float(lam[at[k, v]])) for kk, v in names if kk == k]
            side = spark.createDataFrame(table, f"v string, l{k} double") if table else None
            if side is None:
                continue
            frame = frame.join(side, frame[key].eqNullSafe(side["v"])).drop("v")
            rate = rate * F.exp(F.col(f"l{k}"))
        got = sorted(frame.withColumn("mass", rate).groupBy(*keys).agg(F.sum("mass").alias("mass")).collect(), key=repr)  # sums in one order, so reruns agree
        gradient, hessian, total = -goal.copy(), np.zeros((len(names), len(names))), 0.0
        for r in got:
            own = [at[k, r[key]] for k, key in enumerate(keys)]
            total += r["mass"]
            for i in own:
                gradient[i] += r["mass"]
                for j in own:
                    hessian[i, j] += r["mass"]
        gradient += damp * lam
        hessian[np.diag_indices(len(names))] += damp
        now = total - float(goal @ lam) + float(damp @ lam**2) / 2
        if now > value + 1e-9 * abs(value) and np.abs(move).max() > 1e-12:  # the step overshot: halve it
            lam, move = lam - move / 2, move / 2
            continue
        value = now
        if np.abs(gradient).max(initial=0) <= tolerance * max(1.0, goal.max(initial=0)):
            break
        move = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-300))
        lam = lam + move
    solved = [dict.fromkeys(t, -math.inf) for t in targets]
    for (k, v), i in at.items():
        solved[k][v] = float(lam[i])
    return solved


def rates_of(cells: list[tuple], targets: dict, multipliers: tuple[dict, dict], most: float) -> dict[tuple, float]:
    """(source, band) -> rate. cells: (source, band, words). Each source's rates are exp of its multiplier and the bands', at
    most `most`, with the source's multiplier set so that its target is met."""
    out: dict[tuple, float] = {}
    by: dict = {}
    for source, band, words in cells:
        by.setdefault(source, []).append((band, words))
    for source, bands in by.items():
        words = np.array([w for _, w in bands], float)
        tilt = np.exp([multipliers[1].get(b, 0.0) for b, _ in bands])
        low, high = 0.0, most / tilt.min()
        if targets[source] >= most * words.sum():
            low = high
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if float(words @ np.minimum(most, middle * tilt)) < targets[source] else (low, middle)
        out |= {(source, b): float(min(most, high * t)) for (b, _), t in zip(bands, tilt, strict=True)}
    return out


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, rate, copies, taken of every row."""
    spark = docs.sparkSession
    band = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size"))).cast("int"))
    rows = stored(sized(docs).withColumn("band", band), "sizes")
    cells = stored(rows.groupBy("source", "band").agg(F.sum("size").cast("double").alias("words")), "cells")  # at most 40 rows a source
    held = sorted(((r["source"], r["band"], r["words"]) for r in cells.collect()), key=repr)
    own: dict = {}
    share: dict = {}
    for source, b, words in held:
        own[source] = own.get(source, 0.0) + words
        if words:
            share[b] = share.get(b, 0.0) + words
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))  # code points order as UTF-8 does
    total = sum(own.values())
    goal = dict(zip(order, targets_of([own[s] for s in order], [weights[k % len(weights)] for k in range(len(order))], total, most), strict=True))
    reached = sum(goal.values()) / total if total else 0.0
    live = cells.filter("words > 0").select("source", F.col("band").cast("string").alias("band"), "words")
    solved = solve_dual(live, ["source", "band"], [goal, {str(b): reached * w for b, w in share.items()}], ridge=(0.0, RIDGE)) if reached else [{}, {}]
    rates = rates_of([c for c in held if c[2] > 0], goal, (solved[0], {int(b): m for b, m in solved[1].items()}), most)
    plan = [(s, b, int(own[s]), goal[s], rates.get((s, b), 0.0)) for s, b, _ in held]
    sources = spark.createDataFrame(plan, "s string, b int, source_size long, target double, rate double")
    here = lambda one, two: one["source"].eqNullSafe(two["s"]) & one["band"].eqNullSafe(two["b"])
    rated = rows.join(sources, here(rows, sources)).drop("s", "b")
    # place in the source by size, then salt and draw: rates of the sizes before, documents before the salt in the size, in the salt
    cell = rows.groupBy("source", "band", "size").agg(F.count("*").alias("n"))
    cell = cell.join(sources.select("s", "b", "rate"), here(cell, sources))
    above = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    cell = cell.select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("n") / PER_SALT).cast("long").alias("salts"), (F.sum("n").over(above) - F.col("n")).alias("before"), (F.sum(F.col("n") * F.col("rate")).over(above) - F.col("n") * F.col("rate")).alias("owed"))
    salted = rated.join(cell, rated["source"].eqNullSafe(cell["s"]) & (rated["size"] == cell["z"])).drop("s", "z").withColumn("salt", F.pmod("draw", "salts"))
    part = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    part = part.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), (F.sum("n").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("inside"))
    ranked = salted.join(part, salted["source"].eqNullSafe(part["s"]) & (salted["size"] == part["z"]) & (salted["salt"] == part["t"])).drop("s", "z", "t")
    ranked = ranked.withColumn("place", F.col("inside") + F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("draw", "doc_id"))).withColumn("rank", F.col("before") + F.col("place"))
    due = lambda k: F.floor(F.col("owed") + F.col("rate") * k + 0.5)
    copies = F.greatest(due(F.col("place")) - due(F.col("place") - 1), F.lit(0)).cast("long")
    ranked = stored(ranked.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.lit(int(most)))).otherwise(F.lit(0).cast("long"))).drop("salt", "salts", "before", "inside", "owed", "place"), "copies")
    ranked = _closing_draws(ranked, int(most))
    shift = _closing_moves(ranked, int(most))
    if shift:
        moves = spark.createDataFrame(shift, "s string, r long, d long")
        ranked = ranked.join(F.broadcast(moves), ranked["source"].eqNullSafe(moves["s"]) & (ranked["rank"] == moves["r"]), "left").withColumn("copies", F.col("copies") + F.coalesce("d", F.lit(0))).drop("s", "r", "d")
    return ranked.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _closing_draws(ranked: DataFrame, most: int, passes: int = 4) -> DataFrame:
    """Where documents too large to take leave a source over 1% off, one copy more or less of a hash-drawn share of its small ones."""
    for k in range(passes):
        sums = ranked.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.first("target").alias("target")).collect()  # one row a source
        gaps = {r["source"]: r["target"] - r["got"] for r in sums if abs(r["target"] - r["got"]) > 0.01 * r["target"] + 1}
        if not gaps:
            break
        want = ranked.sparkSession.createDataFrame([(s, abs(g), 1 if g > 0 else -1) for s, g in gaps.items()], "s string, gap double, way long")
        able = (F.col("copies") + F.col("way")).between(0, most) & (F.col("size") > 0) & (F.col("size") * 4 <= F.col("gap"))
        joined = ranked.join(F.broadcast(want), ranked["source"].eqNullSafe(want["s"]), "left").withColumn("able", F.coalesce(able, F.lit(False)))
        pool = {r["source"]: r["w"] for r in joined.filter("able").groupBy("source").agg(F.sum("size").alias("w")).collect()}
        if not pool:
            break
        share = ranked.sparkSession.createDataFrame([(s, min(1.0, abs(gaps[s]) / w)) for s, w in pool.items()], "t string, share double")
        drawn = F.col("able") & (F.pmod(F.xxhash64("draw", F.lit(k)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        moved = joined.join(F.broadcast(share), joined["source"].eqNullSafe(share["t"]), "left").withColumn("copies", F.col("copies") + F.when(F.coalesce(drawn, F.lit(False)), F.col("way")).otherwise(0))
        ranked = stored(moved.select(*ranked.columns), "copies")
    return ranked


def _closing_moves(ranked: DataFrame, most: int, passes: int = 3) -> list[tuple]:
    """(source, rank, +-1): for each source and pass, the document whose size is nearest to what is missing or too much."""
    sums = ranked.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.first("target").alias("target")).collect()
    missing = {r["source"]: r["target"] - r["got"] for r in sums}
    moves: list[tuple] = []
    spark = ranked.sparkSession
    for _ in range(passes):
        open_ = [(s, float(abs(m)), 1 if m > 0 else -1) for s, m in missing.items() if abs(m) >= 1]
        if not open_:
            break
        want = spark.createDataFrame(open_, "s string, gap double, way long")
        left = ranked.select("source", "rank", "size", "copies").filter("size > 0")
        if moves:
            done = spark.createDataFrame([(s, r) for s, r, _ in moves], "ds string, dr long")
            left = left.join(F.broadcast(done), left["source"].eqNullSafe(done["ds"]) & (left["rank"] == done["dr"]), "left_anti")
        near = left.join(F.broadcast(want), left["source"].eqNullSafe(want["s"])).filter((F.col("copies") + F.col("way")).between(0, most) & (F.col("size") < 2 * F.col("gap")))
        best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("rank"), F.col("size"), F.col("way"))).alias("b")).collect()
        if not best:
            break
        for r in best:
            b = r["b"]
            moves.append((r["source"], b["rank"], b["way"]))
            missing[r["source"]] -= b["way"] * b["size"]
    return moves


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows equal in doc_id, text and source share their copies as evenly as whole numbers do."""
    key = ["id", "source", "hash"]
    plan = mixture(docs, weights, most).groupBy(F.col("doc_id").alias("id"), "source", F.col("text_hash").alias("hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    plan = stored(plan.toDF("p_id", "p_source", "p_hash", "copies", "rows"), "plan")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("source"), F.xxhash64(docs["text"].cast("string")).alias("hash"))
    joined = packed.join(plan, F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("hash") == F.col("p_hash")))
    taken = joined.filter("rows = 1").withColumn("times", F.col("copies"))
    if not plan.filter("rows > 1").isEmpty():
        number = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("row")))  # the repeats of one row
        shared = joined.filter("rows > 1").withColumn("number", number)
        shared = shared.withColumn("times", F.floor(F.col("copies") * F.col("number") / F.col("rows")) - F.floor(F.col("copies") * (F.col("number") - 1) / F.col("rows"))).drop("number")
        taken = taken.unionByName(shared)
    return taken.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
