"""Substring deduplication by relative Lempel-Ziv factors.

The reference is the whole corpus, cut into blocks by anchor: of every window of WINDOW words the 8-word gram of least
hash is its anchor, so equal windows have equal anchors at equal places. The windows of one anchor occurrence form a
context, the words from the first window's start to the last one's end. A context that occurs elsewhere whole is a
factor: all of its words are copied. Where the anchor recurs but the context does not, a factor's boundary runs through
it: there the windows are compared one by one with those of the anchor's other contexts. Consecutive factors and
windows join into duplicate spans. Documents are factored against every block that indexes one of their anchors; an
anchor that occurs once rules out all of its windows at once.

Defined cases: null, empty and wordless texts have no words; documents of fewer than WINDOW words keep them all;
repeated rows (equal doc_id and text) count as two occurrences; a null doc_id is a document like others; other columns
are ignored; texts of any length are read whole. Windows are told apart by two 64-bit hashes, of the anchor and of all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import WordHashes, bounded, mix64, pieces, stored, text_bytes

WINDOW = 35
GRAM = 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Prefixes:
    """Hash of any run of words out of a batch, by prefix sums of a polynomial modulo 2^64."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if len(self._powers[0]) < n:
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                self._powers[k] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self._powers[0][: n - 1], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self._powers[1][start])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def contexts(prefixes: Prefixes, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, context hash, first window, last window) of each anchor occurrence; places are in the batch."""
    n = len(prefixes.sums) - 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < WINDOW:
        return none
    at = np.arange(n - GRAM + 1)
    gram = prefixes.of(at, at + GRAM)
    ranked = (gram & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # equal grams: the left one
    anchor = (_sliding_min(ranked, WINDOW - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n - WINDOW + 1)
    doc = np.searchsorted(bounds, start, "right") - 1
    ok = start + WINDOW <= bounds[doc + 1]
    start, doc, anchor = start[ok], doc[ok], anchor[ok]
    if not len(start):
        return none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    a, b, p = start[first], start[last], anchor[first]
    whole = prefixes.of(a, b + WINDOW) ^ mix64(((p - a) * 64 + (b - a)).astype(np.uint64))
    return doc[first], gram[p], whole, a, b


def _batches(part: pa.RecordBatch, hashes: WordHashes) -> tuple[list[list[bytes]], Prefixes, np.ndarray]:
    hashes.trim()
    words = [raw.split() for raw in text_bytes(part.column("text"))]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, Prefixes(np.concatenate([np.zeros(0, np.uint64), *(hashes.of(w) for w in words)])), bounds


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    name = F.col("doc_id").cast("long")
    return bounded(docs).select(F.coalesce(name, F.lit(0)).alias("key"), F.xxhash64(text, name.isNull()).alias("body"), name.alias("doc_id"), text.alias("text"))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """key, body, spans: for each document (by id and a hash of its text) with copied words, the word ranges [start, stop), not yet joined."""
    keyed = _keyed(docs)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                _, prefixes, bounds = _batches(part, hashes)
                doc, anchor, whole, a, b = contexts(prefixes, bounds)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("body").take(at), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((a - bounds[doc]).astype(np.int32)), pa.array((b - bounds[doc]).astype(np.int32))], ["key", "body", "anchor", "context", "a", "b"])

    rows = stored(keyed.select("key", "body", "text").mapInArrow(factor, "key long, body long, anchor long, context long, a int, b int"), "contexts")
    rows = rows.withColumn("place", F.xxhash64("key", "body", "a"))
    kinds = stored(rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("place").alias("chosen")), "kinds")
    often = kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1").select("anchor", "kinds")
    known = kinds.join(often, "anchor")
    found = stored(rows.join(known, ["anchor", "context"]).select("key", "body", "anchor", "a", "b", "n", "kinds", (F.col("place") == F.col("chosen")).alias("speaks")), "factors")
    whole = found.filter("n > 1").select("key", "body", F.col("a").alias("start"), (F.col("b") + WINDOW).alias("stop"))

    # boundaries: one occurrence of each context speaks for it, and names its windows
    asked = found.filter("kinds > 1 and speaks").groupBy("key", "body").agg(F.collect_list(F.struct("anchor", "a", "b", (F.col("n") == 1).alias("alone"))).alias("asked"))
    texts = keyed.select("key", "body", "text").dropDuplicates(["key", "body"]) if _repeats(rows) else keyed.select("key", "body", "text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                _, prefixes, bounds = _batches(part, hashes)
                asked = part.column("asked")
                doc = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                items = asked.flatten()
                a, b = (items.field(k).to_numpy().astype(np.int64) for k in (1, 2))
                size = b - a + 1
                of = np.repeat(np.arange(len(a)), size)
                start = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                at = start + bounds[doc[of]]
                window = prefixes.of(at, at + WINDOW)
                row = pa.array(doc[of])
                yield pa.RecordBatch.from_arrays([part.column("key").take(row), part.column("body").take(row), items.field(0).take(pa.array(of)), pa.array(window.view(np.int64)), pa.array(start.astype(np.int32)), items.field(3).take(pa.array(of))], ["key", "body", "anchor", "window", "start", "alone"])

    windows = stored(texts.join(asked, ["key", "body"]).mapInArrow(name, "key long, body long, anchor long, window long, start int, alone boolean"), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    edges = windows.filter("alone").join(twice, ["anchor", "window"]).select("key", "body", "start", (F.col("start") + WINDOW).alias("stop"))
    return whole.union(edges).distinct().groupBy("key", "body").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _repeats(rows: DataFrame) -> bool:
    """Whether one document stands in the table twice: the same window at the same place of the same key."""
    return not rows.filter("a = 0").groupBy("key", "body").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def remove_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every row; kept are the words that no repeated window covers, joined by a space."""
    return _removed(docs, True)


def removal(docs: DataFrame) -> DataFrame:
    """remove_copies without the kept text."""
    return _removed(docs, False)


def _removed(docs: DataFrame, with_text: bool) -> DataFrame:
    spans = stored(duplicate_spans(docs), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                spans = part.column("spans")
                offsets = spans.offsets.to_numpy()
                items = spans.values
                start, stop = (items.field(k).to_numpy() for k in (0, 1))
                out: list[tuple] = []
                for k, raw in enumerate(text_bytes(part.column("text"))):
                    words = raw.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start[offsets[k] : offsets[k + 1]], 1)
                    np.add.at(edge, stop[offsets[k] : offsets[k + 1]], -1)
                    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    body = b" ".join(words if len(kept) == len(words) else [words[i] for i in kept.tolist()])
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace") if with_text else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in out], kinds[k]) for k in range(3 + with_text))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    joined = _keyed(docs).join(spans, ["key", "body"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
