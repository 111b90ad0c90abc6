"""Language identification by prediction by partial matching.

One context tree over bytes (orders 0 to 3; symbols are the bytes seen in training, and one more that starts a text and
stands for bytes never seen) carries counts per language; of order 3 each language's most frequent contexts are kept.
Escape probabilities follow method C with exclusion, so each language's probabilities sum to one in every context.
Statistics are frozen once learned, which turns the tree into a table: node of the last three bytes, next byte ->
bits under each language. A text's exact code length is a sum of table entries over all its bytes; the language of
the shortest code wins, and the score is its share of the languages' likelihood.

Defined cases: null text or text without a letter is `und` with score 0; empty training data makes every row `und`;
ties go to the first language by code point; repeated rows are predicted alike; a null doc_id is not held out and is
not learned from; texts of any length are coded whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.llm.common import bounded, lean, pieces, remainder, remove, stored, text_bytes

ROWS_PER_LANGUAGE = 1500  # bounds of the labelled sample the trees are learned from
BYTES_PER_LANGUAGE = 8 << 20
DEEP_NODES = 2500  # order-3 contexts kept of each language, the most frequent
FOREIGN_BITS = 8.0  # a byte: a text that its best model makes longer than it is is in none of the languages

UND = "und"
_letter = regex.compile(r"\p{L}")


def training_sample(docs: DataFrame, modulus: int = 4, held: int = 2, rows: int = ROWS_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """Texts by language: about `rows` labelled rows of each, chosen by a hash of doc_id, at most BYTES_PER_LANGUAGE."""
    learn = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter((remainder("doc_id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, int(scale * rows / n)))])
    draw = F.xxhash64("doc_id", "text", F.lit(8))
    chosen = learn.filter(F.pmod(draw, F.lit(scale)) < share[F.col("lang")]).withColumn("draw", draw).withColumn("size", F.octet_length("text").cast("long"))
    # in the order of the draw as many whole texts as the bound in bytes has room for; the window runs over the sample's few rows
    chosen = stored(chosen.select("lang", "draw", "size", "doc_id", "text"), "sample")
    fits = chosen.select("lang", "draw", "doc_id", F.sum("size").over(W.partitionBy("lang").orderBy("draw", "doc_id")).alias("upto")).filter(F.col("upto") <= BYTES_PER_LANGUAGE)
    out: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(chosen.join(fits.select("lang", "draw", "doc_id").distinct(), ["lang", "draw", "doc_id"]).collect(), key=lambda r: (r["draw"], r["doc_id"])):
        out[r["lang"]].append(r["text"].encode())
    remove(docs.sparkSession, chosen)
    return out


class Model:
    """Frozen tables: `classes` byte -> symbol, `node` of three symbols, `bits` of (node, symbol) by language."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        if not self.langs:
            return
        seen = np.zeros(256, bool)
        for lang in self.langs:
            for raw in texts[lang]:
                seen[np.frombuffer(raw, np.uint8)] = True
        self.classes = np.zeros(256, np.uint8)
        self.classes[seen] = np.arange(1, seen.sum() + 1) if seen.sum() < 256 else np.minimum(np.arange(1, 257), 255)  # the byte 0xff is in no UTF-8 text
        a = self.symbols = int(self.classes.max()) + 1
        deep: list[tuple[np.ndarray, np.ndarray]] = []  # by language: code of four symbols, its count
        for lang in self.langs:
            keys = [np.zeros(0, np.int64)]
            for raw in texts[lang]:
                s = np.concatenate([np.zeros(3, np.int64), self.classes[np.frombuffer(raw, np.uint8)]])
                keys.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
            deep.append(np.unique(np.concatenate(keys), return_counts=True))
        pairs = [_summed(key % a**3, n) for key, n in deep]  # the last two symbols of the context, and the next
        used = np.unique(np.concatenate([key // a for key, _ in pairs]))
        ctx = np.unique(np.concatenate([_most_frequent(key // a, n) for key, n in deep]))
        at_two = np.tile(np.arange(a, dtype=np.int32), a)
        at_two[used] = np.arange(len(used)) + a
        self.node = np.tile(at_two, a)
        self.node[ctx] = np.arange(len(ctx)) + a + len(used)
        self.bits = np.empty((a * (a + len(used) + len(ctx)), len(self.langs)), np.float32)
        for k, (key, n) in enumerate(deep):
            two = _counts(*pairs[k], used, a)
            one = np.zeros((a, a), np.float32)
            np.add.at(one, used % a, two)
            p0 = _blend(one.sum(0)[None], np.full((1, a), 1 / a, np.float32))
            p1 = _blend(one, np.broadcast_to(p0, one.shape))
            base = np.concatenate([p1, _blend(two, p1[used % a])])
            p3 = _blend(_counts(key, n, ctx, a), base[at_two[ctx % (a * a)]])
            self.bits[:, k] = -np.log2(np.concatenate([base, p3])).ravel()

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language, texts x languages."""
        a, out, chunk = self.symbols, np.zeros((len(texts), len(self.langs))), 1 << 20
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes + 3)])
        symbols = self.classes[raw]
        for k in range(len(texts)):  # the three leading symbols stand for the start, whatever class byte 0 has
            symbols[starts[k] : starts[k] + 3] = 0
        for lo in range(3, len(symbols), chunk):
            hi = min(lo + chunk, len(symbols))
            s = symbols[lo - 3 : hi].astype(np.int32)
            cell = self.node[(s[:-3] * a + s[1:-2]) * a + s[2:-1]] * a + s[3:]
            cost = self.bits[cell]
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, hi, "left"))
            for k in range(first, last):  # whole runs of one text
                x, y = max(starts[k] + 3, lo), min(starts[k + 1], hi)
                if y > x:
                    out[k] += cost[x - lo : y - lo].sum(0, dtype=np.float64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte under that language's model of each text."""
        langs, scores, rates = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        ok = [k for k, t in enumerate(texts) if t and _letter.search(t.decode("utf-8", "replace"))] if self.langs else []
        if ok:
            bits = self.code_lengths([texts[k] for k in ok])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
            for k, b, p in zip(ok, best, share, strict=True):
                langs[k], scores[k] = self.langs[b], p
            rates[ok] = bits.min(1) / [len(texts[k]) for k in ok]
        return langs, scores, rates


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, back = np.unique(key, return_inverse=True)
    return out, np.bincount(back, n, len(out)).astype(np.int64)


def _most_frequent(context: np.ndarray, n: np.ndarray) -> np.ndarray:
    out, total = _summed(context, n)
    return out[np.argsort(-total, kind="stable")[:DEEP_NODES]]


def _counts(key: np.ndarray, n: np.ndarray, contexts: np.ndarray, a: int) -> np.ndarray:
    """Contexts x symbols: how often each symbol followed."""
    out = np.zeros((len(contexts), a), np.float32)
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, key // a), len(contexts) - 1)
        ok = contexts[at] == key // a
        out[at[ok], key[ok] % a] = n[ok]
    return out


def _blend(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Method C with exclusion: counts and parent are nodes x symbols; unseen nodes take the parent's."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True).astype(np.float32)
    seen = counts > 0
    rest = 1 - np.where(seen, parent, 0).sum(1, keepdims=True)
    escape = np.where(rest > 1e-9, kinds / np.maximum(total + kinds, 1), 0)
    own = np.where(escape > 0, counts / np.maximum(total + kinds, 1), counts / np.maximum(total, 1))
    return np.where(total > 0, np.where(seen, own, escape * parent / np.maximum(rest, 1e-9)), parent).clip(1e-12).astype(np.float32)


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, rows: int = ROWS_PER_LANGUAGE) -> Model:
    return Model(training_sample(docs, modulus, held, rows))


def _share(spark, model: Model):
    return spark.sparkContext.broadcast(model)  # (a + used pairs of symbols + DEEP_NODES a language) x a floats a language, a <= 256 symbols


def identify(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                langs, scores, _ = shared.value.predict(text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, unchanged, whose text is in one of the model's languages: not `und`, and coded by the best in FOREIGN_BITS a byte at most."""
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                langs, _, rates = shared.value.predict(text_bytes(part.column("text")))
                kept = part.filter(pa.array([x != UND and r <= FOREIGN_BITS for x, r in zip(langs, rates.tolist(), strict=True)], pa.bool_()))
                if kept.num_rows:
                    yield kept

    return bounded(docs).mapInArrow(lean(run), docs.schema)
