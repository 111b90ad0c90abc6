"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (words and word beginnings learned from labels by log odds, and a
small fixed one), their share near a second-person pronoun, capitals, punctuation and obfuscation rates, and length.
They are learned from a bounded sample of labelled rows by cross-fitting, at any size: a row's features come from a
lexicon learned without its fold, and the margin that calibrates it from trees grown without its fold, so no stage sees
the noise that an earlier one fitted. What scores other texts is learned from all folds.

Defined cases: null, empty and wordless texts have features of 0 and the score that these give; without usable labels,
or with labels of one class only, every score is that class's share (0.5 without labels); rows that repeat are scored
alike; a null doc_id is not held out and not learned from; of several labels of a doc_id the greatest counts; texts of
any length are read whole; other columns are ignored. The sample has SAMPLE_ROWS rows, the lexicon LEXICON forms, each of
LEAST_TEXTS toxic texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import bounded, pieces, remainder, stored, text_bytes

SAMPLE_ROWS = 9000  # bound of the labelled sample
LEXICON, LEAST_TEXTS = 600, 3
FOLDS = 5
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15

#: Second-person pronouns, and insults that are common in English.
SECOND = "you your yours yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr tú ti usted ustedes vosotros vuestro".split()
INSULTS = "idiot moron stupid dumb loser pathetic disgusting worthless trash scum clown fool imbecile jerk ugly vermin filth".split()

#: Characters that stand for letters in disguised words.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_edge = re.compile(r"^[\W_]+|[\W_]+$")
_again = re.compile(r"(.)\1{2,}")
STRONG, WEAK, PERSON, HIDDEN, CAPS, UNMASKED, STRETCHED, FIXED = (1 << k for k in range(8))
FEATURES = ("strong", "weak", "fixed", "any", "near_person", "person", "hidden", "unmasked", "stretched", "caps_words", "capitals", "exclamation", "question", "symbols", "digits", "length")


def normal(word: str) -> str:
    return _again.sub(r"\1", _edge.sub("", word).lower())


def beginnings(word: str) -> list[str]:
    return [f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k]


class Words(dict):
    """Flags of each word (as it stands), kept for the words seen last."""

    def __init__(self, strong: set[str], weak: set[str]):
        super().__init__()
        self.strong, self.weak = strong, weak

    def _listed(self, word: str) -> int:
        forms = [word, *beginnings(word)]
        return (STRONG if any(f in self.strong for f in forms) else WEAK if any(f in self.weak for f in forms) else 0) | (FIXED if word in _fixed else 0)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        bare = _edge.sub("", word)
        plain = normal(word)
        flags = self._listed(plain) if plain else 0
        if plain in _second:
            flags |= PERSON
        if len(bare) > 1 and bare.isupper():
            flags |= CAPS
        if len(plain) < len(bare):
            flags |= STRETCHED
        if bare and not bare.isalpha() and any(c.isalpha() for c in bare) and (shown := bare.lower().translate(_DISGUISE)) != bare.lower() and shown.isalpha():
            flags |= HIDDEN
            if self._listed(_again.sub(r"\1", shown)):
                flags |= UNMASKED | STRONG
        self[raw] = flags
        return flags

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


_second, _fixed = set(SECOND), set(INSULTS)


def features(texts: list[bytes], words: Words) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    words.trim()
    for k, raw in enumerate(texts):
        found = raw.split()
        n = len(found)
        if not n:
            continue
        flags = np.fromiter(map(words.__getitem__, found), np.uint8, n)
        listed = (flags & (STRONG | WEAK | FIXED)) > 0
        person = (flags & PERSON) > 0
        near = 0
        if listed.any() and person.any():
            places = np.flatnonzero(person)
            at = np.flatnonzero(listed)
            right = np.searchsorted(places, at)
            gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(at - places[np.maximum(right - 1, 0)]))
            near = int((gap <= 5).sum())
        bits = [int(((flags & f) > 0).sum()) for f in (STRONG, WEAK, FIXED)]
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        capitals, small = counts[65:91].sum(), counts[97:123].sum()
        symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
        out[k] = (
            *(np.log1p(b) / np.log1p(n) for b in bits),
            int(listed.sum()) / n,
            near / n,
            int(person.sum()) / n,
            *(int(((flags & f) > 0).sum()) / n for f in (HIDDEN, UNMASKED, STRETCHED, CAPS)),
            capitals / max(1, capitals + small),
            counts[33] / n,
            counts[63] / n,
            symbols / n,
            counts[48:58].sum() / n,
            np.log1p(n),
        )
    return out


def forms(raw: bytes) -> set[str]:
    """The normal words of a text and their beginnings (ending in ~)."""
    return {f for w in {normal(w) for w in set(raw.decode("utf-8", "replace").split())} if w for f in (w, *beginnings(w))}


def lexica(texts: list[bytes], labels: np.ndarray, fold: np.ndarray, most: int = LEXICON) -> list[tuple[set[str], set[str]]]:
    """For each of FOLDS folds the lexicon of the rows outside of it, and that of all rows: strong and weak forms, by smoothed log odds of toxic texts.

    Only forms of toxic texts are counted, so what is held does not grow with the other texts.
    """
    at: dict[str, int] = {}
    toxic = np.flatnonzero(labels).tolist()
    found = [np.array([at.setdefault(f, len(at)) for f in forms(texts[k])], np.int32) for k in toxic]
    counts = np.zeros((len(at), 2, FOLDS + 1), np.int32)
    for k, ids in zip(toxic, found, strict=True):
        counts[ids, 1, fold[k]] += 1
    for k in np.flatnonzero(labels == 0).tolist():
        counts[[at[f] for f in forms(texts[k]) if f in at], 0, fold[k]] += 1
    totals = np.stack([np.bincount(fold[labels == y], minlength=FOLDS + 1) for y in (0, 1)])
    names, out = np.array(list(at), object), []
    for own in range(FOLDS + 1):  # the last has no rows of its own
        (clean, toxic), (n, m) = (counts.sum(2) - counts[:, :, own]).T, totals.sum(1) - totals[:, own]
        odds = np.log((toxic + 0.5) / (m - toxic + 0.5)) - np.log((clean + 0.5) / (n - clean + 0.5))
        good = np.flatnonzero((toxic >= LEAST_TEXTS) & (odds > 1.5))
        ranked = sorted(((odds[k] + 0.2 * np.log(toxic[k]), names[k], odds[k]) for k in good), reverse=True)[:most]
        out.append(({f for _, f, o in ranked if o > 3}, {f for _, f, o in ranked if o <= 3}))
    return out


def lexicon(texts: list[bytes], labels: np.ndarray, most: int = LEXICON) -> tuple[set[str], set[str]]:
    """Words and word beginnings (ending in ~) of toxic texts by smoothed log odds: strong ones, weak ones."""
    return lexica(texts, labels, np.zeros(len(texts), np.int64), most)[-1]


class Trees:
    """Histogram gradient boosting of logistic loss with full binary trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.depth = float(np.log(share / (1 - share))), depth
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        positive = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 9)[:-1])])) if len(v := x[x[:, j] > 0, j]) else c for j, c in enumerate(cuts)]
        cuts = [np.unique(np.concatenate([p, [0.0]])) for p in positive]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        margin = np.full(len(y), self.base)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-6)
                split = [(0, np.inf, width)] * n
                for j, c in enumerate(cuts):
                    cell = node * width + binned[:, j]
                    gs = np.cumsum(np.bincount(cell, g, n * width).reshape(n, width), axis=1)
                    hs = np.cumsum(np.bincount(cell, h, n * width).reshape(n, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    gain[:, len(c) :] = 0
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(n), at] > best):
                        best[k], split[k] = gain[k, at[k]], (j, float(c[at[k]]), int(at[k]))
                which = np.array([s[0] for s in split])
                place = np.array([s[2] for s in split])
                feature[first : first + n] = which
                cut[first : first + n] = [s[1] for s in split]
                node = 2 * node + (binned[np.arange(len(y)), which[node]] > place[node])
            value = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            margin += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending margins and the calibrated share at each."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first margin, last margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    share = [(s + 0.25) / (w + 0.5) for s, w, _, _ in blocks]  # never certain
    share = np.maximum.accumulate(share)
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.repeat(share, 2)


class Model:
    def __init__(self, texts: list[bytes], labels: np.ndarray, turn: np.ndarray):
        """turn: a number for each row; rows of one turn modulo FOLDS are a fold."""
        self.words, self.trees, self.curve = Words(set(), set()), None, None
        self.constant = 0.5 if not len(labels) else float(labels.mean())
        if not len(labels) or labels.min() == labels.max():
            return
        x, margin = np.zeros((len(labels), len(FEATURES))), np.zeros(len(labels))
        *without, whole = lexica(texts, labels, turn % FOLDS)
        for f, listed in enumerate(without):
            own = np.flatnonzero(turn % FOLDS == f)
            x[own] = features([texts[k] for k in own], Words(*listed))
        for f in range(FOLDS):
            own = turn % FOLDS == f
            if own.any() and not own.all():
                margin[own] = Trees(x[~own], labels[~own]).margin(x[own])
        self.words, self.trees, self.curve = Words(*whole), Trees(x, labels), isotonic(margin, labels)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        margin = self.trees.margin(features(texts, self.words))
        calibrated = np.interp(margin, *self.curve)
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-margin)), 0, 1)  # steps of the curve keep the margin's order


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", modulus) != held)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = stored(known, "known")
    n, scale = known.count(), 1 << 30
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(scale)) < int(scale * rows / n))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # about `rows` ids
    got = sorted((r["doc_id"], r["text"] or "", r["_toxic"], r["u"]) for r in sample.select("doc_id", "text", "_toxic", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(10)).alias("u")).collect())
    return Model([r[1].encode() for r in got], np.array([int(r[2] > 0) for r in got], np.int64), np.array([r[3] for r in got], np.int64))


def toxicity(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                score = shared.value.score(text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
