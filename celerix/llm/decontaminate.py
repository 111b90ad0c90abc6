"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each task turns its documents into segments, every segment holding, for each
term, the ascending positions at which it stands in the segment's concatenated documents (which are GAP positions
apart, so that no phrase spans two). Every term has postings, so an index serves any benchmark. Segments are stored as
binary rows in the shared folder. A phrase is matched by taking its terms from the rarest upward and intersecting their
position lists, each shifted by the term's offset; what is left are exact starts. Nothing is shuffled: the phrases (a
benchmark, fetched and sent in blocks of bounded size) visit every segment, which looks each of their terms up once.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; items without words are never
found; a null item_id counts as the item_id ``; repeated rows are judged one by one; empty tables give empty results;
texts of any length are indexed whole, a text over the size of a segment in a segment of its own; other columns are
ignored. Spans of proximity searches are at most GAP words; wider ones raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import bounded, lean, pieces, remove, stored, text_bytes

WINDOW = 13
GAP = 64  # widest phrase or proximity span that a segment can answer, in words
BLOCK_BYTES = 32 << 20  # benchmark text sent to the executors at once

#: Bytes that end a word become spaces, A-Z lower case; digits, letters and all bytes from 0x80 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class _Codes(dict):
    """Terms numbered as they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = code = len(self)
        return code


class Segment:
    """Documents' word counts and the postings of each term."""

    def __init__(self, sizes: np.ndarray, terms: list[bytes], bounds: np.ndarray, positions: np.ndarray):
        self.sizes, self.bounds, self.positions = sizes, bounds, positions
        self.starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.at = {t: k for k, t in enumerate(terms)}
        self.terms = terms

    @staticmethod
    def build(texts: list[bytes]) -> Segment:
        ids = _Codes()
        sizes, codes, places, start = np.zeros(len(texts), np.int64), [], [], 0
        for k, raw in enumerate(texts):
            found = words_of(raw)
            sizes[k] = len(found)
            codes.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
            places.append(np.arange(start, start + len(found), dtype=np.uint32))
            start += len(found) + GAP
        code = np.concatenate([np.zeros(0, np.int32), *codes])
        place = np.concatenate([np.zeros(0, np.uint32), *places])
        order = np.argsort(code, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(ids)))])
        return Segment(sizes, list(ids), bounds.astype(np.uint32), place[order])

    def dump(self) -> bytes:
        words = b"\n".join(self.terms)
        arrays = [self.sizes.astype("<u4"), self.bounds.astype("<u4"), self.positions.astype("<u4")]
        head = json.dumps({"words": len(words), "sizes": [len(a) for a in arrays]}).encode()
        return b"PIX1" + len(head).to_bytes(4, "little") + head + words + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def load(blob: bytes) -> Segment:
        if blob[:4] != b"PIX1":
            raise ValueError("not an index segment")
        n = int.from_bytes(blob[4:8], "little")
        head, at = json.loads(blob[8 : 8 + n]), 8 + n
        words = blob[at : at + head["words"]]
        at += head["words"]
        arrays = []
        for size in head["sizes"]:
            arrays.append(np.frombuffer(blob, "<u4", size, at))
            at += 4 * size
        return Segment(arrays[0].astype(np.int64), words.split(b"\n") if words else [], arrays[1].astype(np.int64), arrays[2])

    def postings(self, term: bytes) -> np.ndarray:
        k = self.at.get(term)
        return self.positions[:0] if k is None else self.positions[self.bounds[k] : self.bounds[k + 1]]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Ascending positions at which the phrase starts."""
        at = [self.at.get(t) for t in terms]
        return self.positions[:0].astype(np.int64) if None in at else self._starts(np.array(at, np.int64))

    def _starts(self, at: np.ndarray) -> np.ndarray:
        """phrase() of terms by their places in the segment."""
        found = None
        for i in np.argsort(self.bounds[at + 1] - self.bounds[at], kind="stable").tolist():
            own = self.positions[self.bounds[at[i]] : self.bounds[at[i] + 1]]
            if found is None:
                found = own.astype(np.int64) - i
            else:
                where = np.searchsorted(own, found + i)
                found = found[(where < len(own)) & (own[np.minimum(where, len(own) - 1)] == found + i)]
            if not len(found):
                break
        return found

    def near(self, terms: list[bytes], span: int) -> list[tuple[int, int]]:
        """Spans (first, last position) of at most `span` words that hold every term, one for each place of the rarest."""
        if span > GAP:
            raise ValueError(f"span is at most {GAP}")
        lists = sorted((self.postings(t).astype(np.int64) for t in set(terms)), key=len)
        out = []
        for p in lists[0].tolist() if lists else []:
            around = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for x in lists[1:]]
            if any(not len(x) for x in around):
                continue
            best = None
            for first in {p, *(int(v) for x in around for v in x if v <= p)}:
                last = [p]
                for x in around:
                    later = x[np.searchsorted(x, first)] if np.searchsorted(x, first) < len(x) else None
                    if later is None:
                        break
                    last.append(int(later))
                else:
                    if max(last) - first < span and (best is None or (max(last) - first, first) < (best[1] - best[0], best[0])):
                        best = (first, max(last))
            if best:
                out.append(best)
        return sorted(set(out))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def build_index(docs: DataFrame, segment_bytes: int = 8 << 20) -> DataFrame:
    """Stored segments (segment_id, ids array<long>, segment binary) of whole texts, with postings of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count()
        for batch in batches:
            for part in pieces(batch, "text", segment_bytes):
                segment = Segment.build(text_bytes(part.column("text")))
                name = f"{TaskContext.get().partitionId()}-{next(number)}"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([segment.dump()], pa.binary())], ["segment_id", "ids", "segment"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lean(run), "segment_id string, ids array<long>, segment binary"), "postings")


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """(item_id, text) in blocks of at most about `limit` bytes, held one at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter(F.col("t").isNotNull()).toLocalIterator():
        block.append((r["i"] or "", r["t"].encode()))
        held += len(block[-1][1])
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


class Phrases:
    """The distinct windows of some items: terms, and for each window its terms' places among them (-1 beyond a short one's end) and its items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        codes, by_window = _Codes(), {}
        for name, raw in items:
            for w in windows_of(words_of(raw), size):
                by_window.setdefault(tuple(map(codes.__getitem__, w)), set()).add(name)
        self.terms, self.items = list(codes), list(by_window.values())
        self.lengths = np.fromiter(map(len, by_window), np.int64, len(by_window))
        self.at = np.full((len(by_window), int(self.lengths.max(initial=0))), -1, np.int64)
        for k, w in enumerate(by_window):
            self.at[k, : len(w)] = w

    def found(self, segment: Segment) -> Iterator[tuple[int, np.ndarray]]:
        """(window, ascending starts) of the windows that stand in the segment; only those whose terms all do are intersected."""
        if not len(self.at):
            return
        place = np.append(np.fromiter((segment.at.get(t, -1) for t in self.terms), np.int64, len(self.terms)), -2)
        places = place[self.at]  # -2: no term; -1: a term that the segment lacks
        for k in np.flatnonzero(~(places == -1).any(1)).tolist():
            starts = segment._starts(places[k, : self.lengths[k]])
            if len(starts):
                yield k, starts


def find_items(index: DataFrame, items: list[tuple[str, bytes]], size: int = WINDOW) -> DataFrame:
    """One row for each indexed document: its segment and place there, doc_id, n_words, hit spans in words, ids of the items found, and whether a window of `size` words was."""
    shared = index.sparkSession.sparkContext.broadcast(items)  # a block of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, size)
        for batch in batches:
            for name, ids, blob in zip(*(batch.column(c).to_pylist() for c in ("segment_id", "ids", "segment")), strict=True):
                segment, n = Segment.load(blob), len(ids)
                spans: list[list[tuple[int, int]]] = [[] for _ in ids]
                owners_of: list[set[str]] = [set() for _ in ids]
                full = np.zeros(n, bool)
                for k, starts in phrases.found(segment):
                    length = int(phrases.lengths[k])
                    docs = segment.doc_of(starts)
                    full[docs] |= length == size
                    for p, d in zip((starts - segment.starts[docs]).tolist(), docs.tolist(), strict=True):
                        spans[d].append((p, p + length))
                        owners_of[d] |= phrases.items[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64()), pa.array(segment.sizes, pa.int64()), pa.array([merged(x) for x in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in owners_of], pa.list_(pa.string())), pa.array(full)],
                    ["segment_id", "ordinal", "doc_id", "n_words", "spans", "items", "full_window"],
                )

    return index.mapInArrow(lean(run), "segment_id string, ordinal long, doc_id long, n_words long, spans array<array<long>>, items array<string>, full_window boolean")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and full_window (whether a window of `size` words stands in it) of every document row."""
    index = build_index(docs)
    blocks = [stored(find_items(index, block, size), "found") for block in _blocks(benchmark, block_bytes)]
    if blocks:
        remove(index.sparkSession, index)
    found = blocks[0] if blocks else find_items(index, [], size)
    if len(blocks) > 1:
        for more in blocks[1:]:
            found = found.unionByName(more)
        found = found.groupBy("segment_id", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("full_window").alias("full_window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_pylist()
            spans = batch.column("spans").to_pylist()
            items = batch.column("items").to_pylist()
            hit = [sum(b - a for a, b in merged([tuple(x) for x in s])) for s in spans]
            digest = [hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(set(x)) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)], pa.bool_()), batch.column("full_window")],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "full_window"],
            )

    return found.mapInArrow(lean(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, full_window boolean")


def proximity_matches(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """doc_id, first, last: spans of at most `span` words that hold all the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [t.encode() for t in terms]
        for batch in batches:
            for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                segment = Segment.load(blob)
                rows = [(ids[d], a - int(segment.starts[d]), b - int(segment.starts[d])) for a, b in segment.near(wanted, span) for d in [int(segment.doc_of(np.array([a]))[0])]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc_id", "first", "last"])

    return index.mapInArrow(lean(run), "doc_id long, first long, last long")
