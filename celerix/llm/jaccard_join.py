"""Exact Jaccard self-join of documents over word shingles, by universe partition and pigeonhole.

A document is the set of its distinct 5-word shingles. Sizes fall into bands; for pairs whose smaller set lies in band
j, shingles are hashed into m(j) segments. Sets that are alike enough differ in at most H(j) shingles, so at least
m(j) - H(j) = slack(j) + 1 segments hold identical subsets. Each set posts a signature of every non-empty segment
subset; sets that share one are candidates. Where a signature is shared by many unlike sets it is skipped, which the
slack pays for. Sets that must skip more than the slack are compared among each other once more: there the
one-deletion neighbourhoods of their subsets are indexed too (two subsets that differ in one shingle share a
signature), and each set buys, at the least total frequency, segments matched exactly (worth 1) or up to one deletion
(worth 2) until they are worth H(j) + 1, which again no like pair can miss. Candidates are verified on the whole sets.

Equal sets are one class from the start (64-bit set hash; shingles are 64-bit hashes too). In a bucket of k sets first
only the pairs with its least set are verified; buckets whose sets are then in one component are settled. In the others
the sets of different components meet in tiles of at most 2 * BLOCK of them, cut by hash, where 128-byte parities rule
unlike pairs out as they are formed; of the pairs left a task gives a spanning part, and only where one of these fails
on the whole sets the others follow. That gives the components; link_counts then counts the links within each of them,
as like sets are in one.

Defined cases: null, empty and wordless texts have the empty set and link with nothing; fewer than 5 words are one
shingle; repeated rows link; two rows of one doc_id are two documents with that id, and their component_id is the same
least id if they link; a null doc_id links like any other and is the component_id only where no other id is in reach;
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import WordHashes, bounded, lean, mix64, pieces, remove, stored, text_bytes, text_id

WIDTH = 5
PERCENT = 80
LEAST = 4  # the smallest set that can be like a different one: 4 of 5
BUSY = 4096  # pairs of different components, for each set of a signature, beyond which it is skipped: where they cost as much as the neighbourhoods of the sets that skip
BLOCK = 1024  # sets of a signature or component, about, that meet as many others in one task
BROADCAST_IDS = 1_000_000  # ids (16 bytes each) sent to every executor at most; more are joined by shuffle
PARITY_BITS = 1024
SEEN = 1_000_000  # set hashes remembered by a task, to post copies once


def _bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, H and slack of each band."""
    first = [LEAST]
    while first[-1] < 1 << 30:
        first.append(max(first[-1] + 1, first[-1] * 5 // 4))
    top = np.array(first[1:], np.int64) - 1
    most = (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    slack = np.maximum(1, np.ceil(0.15 * (most + 1)).astype(np.int64))
    return np.array(first[:-1], np.int64), most, slack


FIRST, MOST, SLACK = _bands()
SEGMENTS = MOST + 1 + SLACK
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, WIDTH)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += mix64(words[k : n - width + 1 + k] + _POWERS[k]) * _POWERS[k]
    return np.unique(mix64(total + np.uint64(width)))


def document_sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    hashes.trim()
    return [shingles(hashes.of(raw.lower().split())) for raw in texts]  # bytes.lower() folds A-Z alone, bytes.split() parts at the six white bytes


def set_hash(s: np.ndarray) -> int | None:
    return int(mix64(np.add.reduce(mix64(s + np.uint64(77)), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None


def slots(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, band) for every band that a document posts to: its own, and those that smaller partners are in."""
    ok = np.flatnonzero(sizes >= LEAST)
    own = np.searchsorted(FIRST, sizes[ok], "right") - 1
    low = np.searchsorted(FIRST, np.maximum(LEAST, -(-sizes[ok] * PERCENT // 100)), "right") - 1
    n = own - low + 1
    doc = np.repeat(ok, n)
    return doc, np.repeat(own, n) - (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots (document, band, empty segments), and per non-empty segment its slot and signature; the low byte is the band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    doc, band = slots(sizes)
    m = SEGMENTS[band]
    base = np.cumsum(m) - m
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    flat = np.concatenate([sets[d] for d in doc])
    slot = np.repeat(np.arange(len(doc)), sizes[doc])
    cell = segment_of(flat, band[slot]) + base[slot]
    total = np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, cell, mix64(flat + np.uint64(5)))
    filled = np.bincount(cell, minlength=len(total)) > 0
    of = np.repeat(np.arange(len(doc)), m)
    signature = subset_signature(total, np.arange(len(total)) - base[of], band[of])
    empty = m - np.bincount(of[filled], minlength=len(doc))
    return doc, band, empty, of[filled], signature[filled]


def segment_of(s: np.ndarray, band: np.ndarray) -> np.ndarray:
    return ((mix64(s + (band.astype(np.uint64) + np.uint64(1)) * _POWERS[1]) >> np.uint64(20)) % SEGMENTS[band].astype(np.uint64)).astype(np.int64)


def subset_signature(total: np.ndarray, segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    mixed = mix64(total + mix64(segment.astype(np.uint64) * _POWERS[2] + band.astype(np.uint64)))
    return ((mixed & ~np.uint64(255)) | band.astype(np.uint64)).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, text_id, n_shingles, set_id and, where this task meets the set first, bands, empties, parity and the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                sets = document_sets(text_bytes(part.column("text")), hashes)
                ids = [set_hash(s) for s in sets]
                if len(seen) > SEEN:
                    seen.clear()
                fresh = []
                for k, x in enumerate(ids):
                    if x is not None and x not in seen:
                        seen.add(x)
                        fresh.append(k)
                doc, band, empty, of, signature = signatures([sets[k] for k in fresh])
                bands: list[list[int]] = [[] for _ in ids]
                empties: list[list[int]] = [[] for _ in ids]
                for d, b, e in zip(doc.tolist(), band.tolist(), empty.tolist(), strict=True):
                    bands[fresh[d]].append(b)
                    empties[fresh[d]].append(e)
                parities: list[np.ndarray | None] = [None] * len(ids)
                for k in fresh:
                    parities[k] = parity(sets[k])
                bounds = np.zeros(len(ids) + 1, np.int32)
                np.add.at(bounds, np.array(fresh, np.int64)[doc[of]] + 1 if len(of) else np.zeros(0, np.int64), 1)
                posted = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)), pa.array(signature))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int32())), pa.array(empties, pa.list_(pa.int32())), pa.array(parities, pa.list_(pa.int64())), posted], ["doc_id", "text_id", "n_shingles", "set_id", "bands", "empties", "parity", "posted"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lean(run), "doc_id long, text_id long, n_shingles long, set_id long, bands array<int>, empties array<int>, parity array<long>, posted array<long>"), "signed")


def _shared(posts: DataFrame) -> DataFrame:
    """Stored: signature, set_id, pivot of the signatures that two sets or more post; the pivot is the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ids, pivot, twin = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, False  # the last row, held back: its pivot, and whether its run has more than it
        last = False
        stream = iter(batches)
        while not last:
            batch = next(stream, None)
            last = batch is None
            if not last:
                sig = np.concatenate([sig, batch.column("signature").to_numpy()])
                ids = np.concatenate([ids, batch.column("set_id").to_numpy()])
            if not len(sig):
                continue
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
            s, d = sig[new], ids[new]
            start = np.concatenate([[True], s[1:] != s[:-1]])
            head = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
            least = d[head]
            many = np.concatenate([~start[1:], [False]]) | ~start
            if twin:
                least[head == 0], many[head == 0] = pivot, True
            stop = len(s) if last else len(s) - 1
            keep = np.flatnonzero(many[:stop])
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(d[keep]), pa.array(least[keep])], ["signature", "set_id", "pivot"])
            pivot, twin = int(least[-1]), bool(not start[-1] or (twin and head[-1] == 0))
            sig, ids = s[-1:], d[-1:]

    ordered = posts.repartition("signature").sortWithinPartitions("signature", "set_id")
    return stored(ordered.mapInArrow(lean(run), "signature long, set_id long, pivot long"), "shared")


def components(links: DataFrame) -> DataFrame:
    """Stored: id, component of every id in links (a, b): the least id in reach. Least labels spread, then jump to their own label's label."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "links")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        root = label.select(F.col("id").alias("r"), F.col("component").alias("up"))
        new = stored(step.join(root, step["c"] == root["r"], "left").select("id", "old", F.least("c", F.coalesce("up", "c")).alias("component")), "labels")
        done = new.filter("old <> component").isEmpty()
        remove(label.sparkSession, label)
        label = new.select("id", "component")
        if done:
            remove(label.sparkSession, both)
            return label


def parity(s: np.ndarray) -> np.ndarray:
    """Of each of PARITY_BITS hash cells whether it holds an odd number of the set's shingles, as 64-bit words.

    A cell whose bits differ in two sets holds a shingle of one of them alone, so the number of such cells is at most the size of the sets' difference.
    """
    cell = (mix64(s + np.uint64(99)) >> np.uint64(17)) % np.uint64(PARITY_BITS)
    bits = (np.bincount(cell.astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


class Sets:
    """All distinct sets: their parities, and one document of each from which its shingles are made again where they are needed."""

    def __init__(self, docs: DataFrame, info: DataFrame):
        self.docs = docs
        self.bits = stored(info.filter("parity is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity")), "bits")

    def of(self, wanted: DataFrame) -> DataFrame:
        """Stored: set_id, shingles of each wanted set_id."""
        side = stored(self.bits.join(wanted, "set_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_set")), "wanted")
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = rows.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side, rows["doc_id"].eqNullSafe(side["_id"])).select("_set", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for part in pieces(batch, "text", 2 << 20):
                    sets = document_sets(text_bytes(part.column("text")), hashes)
                    keep = [k for k, x in enumerate(part.column("_set").to_pylist()) if set_hash(sets[k]) == x]
                    yield pa.RecordBatch.from_arrays([pa.array([set_hash(sets[k]) for k in keep], pa.int64()), pa.array([sets[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["set_id", "shingles"])

        found = stored(rows.mapInArrow(lean(run), "set_id long, shingles array<long>"), "sets")
        remove(found.sparkSession, side)
        return found

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parities do not rule out."""
        one, two = (self.bits.select("set_id", "n", "parity").toDF(k, "n" + k, "p" + k) for k in "ab")
        apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count(x))
        return pairs.join(one, "a").join(two, "b").filter(apart * (100 + PERCENT) <= (F.col("na") + F.col("nb")) * (100 - PERCENT)).select("a", "b")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Stored: the pairs (a, b) whose sets are alike, by the whole sets."""
        pairs = stored(pairs, "pairs")
        sets = self.of(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct())
        one, two = (sets.dropDuplicates(["set_id"]).toDF(k, "s" + k) for k in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        found = stored(pairs.join(one, "a").join(two, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * PERCENT).select("a", "b"), "alike")
        for x in (pairs, sets):
            remove(found.sparkSession, x)
        return found


def tiled(rows: DataFrame, key: str, members: Column) -> DataFrame:
    """rows with the tiles (key, lo, hi) in which they meet the others of their key, and their block: members sets of a key
    are cut into blocks of about BLOCK by hash, and each two blocks meet in a tile."""
    blocks = F.ceil(members / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = cut.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")
    return met.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _tiles(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole tiles, and for each row the end of its tile; what is held is a batch and a tile."""
    held: list[pa.RecordBatch] = []
    stream = iter(batches)
    last = False
    while not last:
        batch = next(stream, None)
        last = batch is None
        if not last and batch.num_rows:
            held.append(batch)
        if not held or (not last and not batch.num_rows):
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in (key, "lo", "hi")], axis=1)
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
        stop = whole.num_rows if last else int(first[-1])
        held = [whole.slice(stop)] if stop < whole.num_rows else []
        if stop:
            first = first[first < stop]
            yield whole.slice(0, stop), np.repeat(np.append(first[1:], stop), np.diff(np.append(first, stop)))


def _met(tile: pa.RecordBatch, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (x, y) of one tile, different components (where rows have one) and sizes and parities that fit."""
    n = len(end)
    name, size, block = (tile.column(c).to_numpy().astype(np.int64) for c in ("set_id", "n", "block"))
    part = tile.column("component").to_numpy() if "component" in tile.schema.names else name
    across = tile.column("lo").to_numpy() != tile.column("hi").to_numpy()
    bits = np.ascontiguousarray(tile.column("parity").flatten().to_numpy()).view(np.uint64).reshape(n, -1)
    x = np.arange(n)
    step = 1
    while len(x := x[x + step < end[x]]):
        y = x + step
        ok = (part[x] != part[y]) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * PERCENT) & ~(across[x] & (block[x] == block[y]))
        i, j = x[ok], y[ok]
        if len(i):
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            near = apart * (100 + PERCENT) <= (size[i] + size[j]) * (100 - PERCENT)
            if near.any():
                yield i[near], j[near]
        step += 1


class _Forest:
    """Union by least label; join() tells whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            if len(self.up) > SEEN:
                self.up.clear()
        return a != b


def _candidates(rows: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different components that meet in a signature and fit; of these a spanning part, by task, or all.

    rows: signature, component, set_id, n, parity, members, and for deletion posts deleted and worth (what the set asks: 0, 1 or 2).
    """
    asked = "worth" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for tile, end in _tiles(batches, "signature"):
            name, part = (tile.column(c).to_numpy() for c in ("set_id", "component"))
            if asked:
                deleted, worth = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("deleted", "worth"))
            for x, y in _met(tile, end):
                if asked:
                    ask = lambda q, h: (worth[q] > 0) & (~deleted[q] | (worth[q] == 2)) & ~(deleted[q] & deleted[h]) & ((worth[q] == 2) | ~deleted[h])
                    ok = ask(x, y) | ask(y, x)
                    x, y = x[ok], y[ok]
                if spanning:
                    keep = [k for k, (a, b) in enumerate(zip(part[x].tolist(), part[y].tolist(), strict=True)) if forest.join(a, b)]
                    x, y = x[keep], y[keep]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(name[x], name[y])), pa.array(np.maximum(name[x], name[y]))], ["a", "b"])

    return tiled(rows, "signature", F.col("members")).mapInArrow(lean(run), "a long, b long").distinct()


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.toDF("set_id", "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _joined(rows: DataFrame, label: DataFrame, sets: Sets, links: DataFrame) -> DataFrame:
    """links and further ones, which join all components that a link within a signature of rows (as in _candidates, without the component) joins."""
    tried = stored(_candidates(_labelled(rows, label), True), "tried")
    found = sets.alike(tried)
    links = links.union(found)
    wrong = stored(tried.join(found, ["a", "b"], "left_anti"), "wrong")
    if not wrong.isEmpty():
        links = links.union(sets.alike(_candidates(_labelled(rows, components(links)), False).join(wrong, ["a", "b"], "left_anti")))
    return links


def _band(signature: str = "signature") -> Column:
    return F.col(signature).bitwiseAND(F.lit(255)).cast("int")


def _slack() -> Column:
    return F.array(*[F.lit(int(x)) for x in SLACK])[F.col("band")]


def _allocate(segments: int, need: int, exact: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each segment what it is worth, 0, 1 or 2, at least `need` in all: the cheapest by marginal cost."""
    first = np.where(near < 2 * exact, near / 2, exact)  # where two cost less than twice one, buy both or none at their mean
    second = np.where(near < 2 * exact, near / 2, near - exact)
    cost = np.concatenate([first, second])
    bought = np.argsort(cost, kind="stable")[:need]
    worth = np.bincount(bought % segments, minlength=segments)
    worth[(worth == 1) & (near <= exact)] = 2
    return worth


def deletion_posts(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, deleted, signature) of each segment's whole subset (empty ones too), then of each subset less one shingle."""
    m = int(SEGMENTS[band])
    cell = segment_of(s, np.full(len(s), band))
    part = mix64(s + np.uint64(5))
    total = np.zeros(m, np.uint64)
    np.add.at(total, cell, part)
    segment = np.concatenate([np.arange(m), cell])
    value = np.concatenate([total, total[cell] - part])
    return segment, np.arange(len(segment)) >= m, subset_signature(value, segment, np.full(len(segment), band))


def _deletion_rows(short: DataFrame, sets: Sets, label: DataFrame) -> DataFrame:
    """Stored: rows for _joined of the one-deletion neighbourhoods of the sets of `short` (set_id, band), bought at least
    cost. Signatures within one component are settled and cost nothing."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, component, band, s in zip(*(batch.column(c).to_pylist() for c in ("set_id", "component", "band")), batch.column("shingles"), strict=True):
                segment, deleted, signature = deletion_posts(s.values.to_numpy().view(np.uint64), band)
                n = len(segment)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, component)), pa.array(np.full(n, band, np.int32)), pa.array(segment.astype(np.int32)), pa.array(deleted), pa.array(signature)], ["set_id", "component", "band", "segment", "deleted", "signature"])

    shingles = sets.of(short.select("set_id").distinct())
    named = _labelled(short.join(shingles.dropDuplicates(["set_id"]), "set_id"), label).select("set_id", "component", "band", "shingles")
    posts = stored(named.mapInArrow(lean(post), "set_id long, component long, band int, segment int, deleted boolean, signature long"), "deletions")
    often = posts.groupBy("signature").agg(F.count_if(~F.col("deleted")).alias("whole"), F.count_if("deleted").alias("less"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    often = stored(often.filter("whole > 0 and lo <> hi").select("signature", "whole", "less"), "often")
    # a whole subset meets whole and deleted ones, a deleted one only whole ones; what no other component shares costs nothing
    live = stored(posts.join(often, "signature"), "live")
    exact = F.sum(F.when(~F.col("deleted"), F.col("whole"))).cast("double")
    near = F.sum(F.when(F.col("deleted"), F.col("whole")).otherwise(F.col("whole") + F.col("less"))).cast("double")
    prices = live.groupBy("set_id", "band", "segment").agg(F.coalesce(exact, F.lit(0.0)).alias("exact"), near.alias("near")).groupBy("set_id", "band").agg(F.sort_array(F.collect_list(F.struct("segment", "exact", "near"))).alias("prices"))

    def buy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, band, prices_ in zip(*(batch.column(c).to_pylist() for c in ("set_id", "band", "prices")), strict=True):
                exact, near = np.zeros((2, int(SEGMENTS[band])))
                for p in prices_:
                    exact[p["segment"]], near[p["segment"]] = p["exact"], p["near"]
                worth = _allocate(len(exact), int(MOST[band]) + 1, exact, near)
                n = len(worth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, band, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(worth.astype(np.int32))], ["set_id", "band", "segment", "worth"])

    bought = prices.mapInArrow(lean(buy), "set_id long, band int, segment int, worth int").filter("worth > 0")
    told = live.join(bought, ["set_id", "band", "segment"], "left").select("signature", "set_id", "deleted", F.coalesce("worth", F.lit(0)).alias("worth"), (F.col("whole") + F.col("less")).alias("members"))
    return stored(told.join(sets.bits.select("set_id", "n", "parity"), "set_id"), "asked")


def _skipped(info: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """set_id, band, skip: segments that the set has empty, or with a busy signature (set_id, band, n)."""
    rows = info.filter("size(bands) > 0").select("set_id", F.explode(F.arrays_zip("bands", "empties")).alias("z")).select("set_id", F.col("z.bands").alias("band"), F.col("z.empties").cast("long").alias("n")).filter("n > 0").distinct()
    return (rows if busy is None else rows.unionByName(busy)).groupBy("set_id", "band").agg(F.sum("n").alias("skip"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Sets]:
    """(info, links, labels, sets): info has doc_id, text_id, n_shingles, set_id by row; links (a, b) between set ids, a
    spanning part of all of them; labels the component of each linked set id.

    Like sets share slack + 1 identical segments at least in the smaller one's band. So a pair with a bucket's least set
    that shares fewer signatures is not verified, and a set that has fewer open signatures than that, with the segments
    that it skips there, meets nothing.
    """
    signed = _signed(docs)
    shared = _shared(signed.filter("size(posted) > 0").select("set_id", F.explode("posted").alias("signature")))
    info = stored(signed.drop("posted"), "info")
    remove(docs.sparkSession, signed)
    sets = Sets(docs, info)

    # the least set of each bucket against the others: most links, and components that settle most buckets
    stars = shared.filter("set_id <> pivot").select(F.col("pivot").alias("a"), F.col("set_id").alias("b"), _band().alias("band"))
    stars = stars.groupBy("a", "b", "band").agg(F.count("*").alias("n")).filter(F.col("n") > _slack()).select("a", "b").distinct()
    links = sets.alike(sets.fitting(stars))
    label = components(links)

    # buckets whose sets are not yet in one component: those of different components meet, or are skipped if too many
    named = _labelled(shared.select("signature", "set_id"), label)
    parts = named.groupBy("signature", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("signature").agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("c")).filter("c > 1")
    open_ = open_.select("signature", "members", (F.col("members") * F.col("members") - F.col("q") > 2 * BUSY * F.col("members")).alias("busy"))
    mixed = stored(named.join(open_, "signature"), "mixed")
    skipped = stored(_skipped(info, mixed.filter("busy").groupBy("set_id", _band().alias("band")).agg(F.count("*").alias("n"))), "skipped")
    usual = mixed.filter("not busy").withColumn("band", _band())
    fair = usual.groupBy("set_id", "band").agg(F.count("*").alias("n")).join(skipped, ["set_id", "band"], "left").filter(F.col("n") + F.coalesce("skip", F.lit(0)) > _slack()).select("set_id", "band")
    usual = stored(usual.join(fair, ["set_id", "band"], "left_semi").select("signature", "set_id", "component"), "usual")
    left = usual.groupBy("signature").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("signature", "members")
    rows = usual.join(left, "signature").select("signature", "set_id", "members").join(sets.bits.select("set_id", "n", "parity"), "set_id")
    for x in (shared, mixed):
        remove(docs.sparkSession, x)
    links = _joined(stored(rows, "met"), label, sets, links)

    short = stored(skipped.filter(F.col("skip") > _slack()).select("set_id", "band"), "short")
    if not short.isEmpty():
        label = components(links)
        links = _joined(_deletion_rows(short, sets, label), label, sets, links)
    links = stored(links.distinct(), "links")
    return info, links, components(links), sets


def link_counts(label: DataFrame, sets: Sets) -> DataFrame:
    """set_id, n_links: to how many other sets each linked set is like, all of them.

    Like sets are in one component, so its sets meet in tiles with their shingles: parities first, then the whole sets. A
    tile gives a number a set, not its pairs.
    """
    named = label.toDF("set_id", "part")
    members = named.groupBy("part").agg(F.count("*").alias("members"))
    rows = named.join(members, "part").join(sets.bits.select("set_id", "n", "parity"), "set_id").join(sets.of(named.select("set_id")).dropDuplicates(["set_id"]), "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, end in _tiles(batches, "part"):
            name, n, size = tile.column("set_id").to_numpy(), np.zeros(len(end), np.int64), tile.column("n").to_numpy()
            shingles = tile.column("shingles")
            for x, y in _met(tile, end):
                for a, b in zip(x.tolist(), y.tolist(), strict=True):
                    both = len(np.intersect1d(shingles[a].values.to_numpy().view(np.uint64), shingles[b].values.to_numpy().view(np.uint64), assume_unique=True))
                    if both * 100 >= (size[a] + size[b] - both) * PERCENT:
                        n[a] += 1
                        n[b] += 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(n[some])], ["set_id", "n_links"])

    counted = tiled(rows, "part", F.col("members")).mapInArrow(lean(run), "set_id long, n_links long")
    return counted.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


def _classed(info: DataFrame, label: DataFrame) -> DataFrame:
    """info with class, the component of the row's set or the set itself (null for the empty set), and component_id."""
    named = info.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = named.join(label.toDF("set_id", "component"), "set_id", "left").withColumn("class", F.coalesce("component", "set_id"))
    # classes of one set are settled; the others meet by class, one row a set
    many = named.filter("component is not null").groupBy("class").agg(F.min("least").alias("component_id"))
    named = named.join(many, "class", "left").select(F.col("set_id").alias("_set"), "class", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = info.join(named, info["set_id"] == named["_set"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; not all links are needed for these."""
    info, _, label, _ = jaccard_links(docs)
    return _classed(info, label).select("doc_id", "n_shingles", "component_id")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id and n_links (other sets that the document's set is like, all of them) of every row."""
    info, _, label, sets = jaccard_links(docs)
    out = _classed(info, label).join(link_counts(label, sets).withColumnRenamed("set_id", "s"), F.col("set_id") == F.col("s"), "left")
    return out.select("doc_id", "n_shingles", "component_id", "set_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, but of like rows only one: that with the least doc_id (a null after all others), then
    the least text_id; of several with both equal any. Rows with the empty set are like nothing and all stay."""
    info, _, label, _ = jaccard_links(docs)
    found = stored(_classed(info, label).select("doc_id", "text_id", "class"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    best = found.filter("class is not null").groupBy("class").agg(F.min(rank).alias("r")).select("class", F.col("r.doc_id").alias("best"), F.col("r.text_id").alias("best_text"))
    # one text has one class, so a key is that of one class or of the empty set
    same = F.col("doc_id").eqNullSafe(F.col("best")) & (F.col("text_id") == F.col("best_text"))
    copies = found.join(best, "class").filter(same).groupBy("best", "best_text").agg((F.count("*") > 1).alias("copies"))
    wordless = found.filter("class is null").select(F.col("doc_id").alias("best"), F.col("text_id").alias("best_text")).distinct().withColumn("copies", F.lit(False))
    kept = stored(copies.union(wordless), "kept")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), text_id(docs["text"]).alias("text_id"))
    rows = packed.join(kept, F.col("id").eqNullSafe(F.col("best")) & (F.col("text_id") == F.col("best_text")))
    if not kept.filter("copies").isEmpty():
        rows = rows.filter("not copies").union(rows.filter("copies").dropDuplicates(["best", "best_text"]))
    return rows.select("row.*")
