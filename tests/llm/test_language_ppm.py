import math
from collections import Counter

import numpy as np
from celerix.llm import language_ppm as L

from .conftest import docs_of


def brute_bits(training, symbols, raw):
    """Prediction by partial matching from counts in a dictionary: orders 3 to 0, method C, exclusion. symbols: bytes that have one of their own."""
    alphabet = [None, *sorted(symbols)]  # None: start of text and bytes not seen
    fold = lambda text: [None] * 3 + [b if b in symbols else None for b in text]
    counts = {}
    for text in training:
        s = fold(text)
        for k in range(3, len(s)):
            for order in range(4):
                counts.setdefault(tuple(s[k - order : k]), Counter())[s[k]] += 1
    known = {}

    def chances(context):
        if context in known:
            return known[context]
        below = chances(context[1:]) if context else dict.fromkeys(alphabet, 1 / len(alphabet))
        seen = counts.get(context)
        if not seen:
            known[context] = below
            return below
        total, kinds = sum(seen.values()), len(seen)
        rest = sum(p for s, p in below.items() if s not in seen)
        if rest <= 1e-9:
            out = {s: seen[s] / total for s in alphabet}
        else:
            out = {s: seen[s] / (total + kinds) if s in seen else kinds / (total + kinds) * below[s] / rest for s in alphabet}
        known[context] = out
        return out

    s = fold(raw)
    return -sum(math.log2(chances(tuple(s[k - 3 : k]))[s[k]]) for k in range(3, len(s)))


def test_code_lengths_equal_a_plain_model():
    texts = {"a": [b"abra cadabra " * 5, b"\x00zz"], "b": ["\u00e9t\u00e9 o\u00f9 ".encode() * 9], "c": []}
    model = L.Model(texts)
    p = np.exp2(-model.bits.reshape(-1, model.symbols, 3).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    symbols = {b for x in texts.values() for t in x for b in t}
    tried = [b"abra", b"cadabra abr", "o\u00f9 \u00e9t\u00e9".encode(), b"", b"\x00\xff" * 5, b"zebra" * 40]
    got = model.code_lengths(tried)
    for k, t in enumerate(tried):
        for n, lang in enumerate("abc"):
            want = brute_bits(texts[lang], symbols, t)
            assert abs(got[k, n] - want) < 2e-3 * max(1, want), (t, lang)
    assert got[0, 0] < got[0, 1] and got[2, 1] < got[2, 0]


def test_texts_in_no_learned_language_go(spark):
    rows = [(k, " ".join(["the quick brown fox jumps over a lazy dog", "und dann kam der Hund nach Hause"][k % 2].split() * 5), ["en", "de"][k % 2]) for k in range(40)]
    docs = docs_of(spark, rows)
    more = docs_of(spark, [(100, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043a\u0430\u043a \u0434\u0435\u043b\u0430"), (101, "the brown dog"), (102, "123"), (103, None), (None, "der Hund")])
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in L.keep_identified(more, L.learn(docs)).collect()) == [(False, 101), (True, None)]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.identify(docs, L.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, corpus):
    docs = docs_of(spark, corpus)
    model = L.learn(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    for doc in (1001, 1002, 1003, 1008):
        assert got[doc]["lang_pred"] == "und" and got[doc]["score"] == 0
    assert got[1004]["lang_pred"] == "en" and got[None]["held_out"] is False
    kept = L.keep_identified(docs, model)
    rates = model.predict([(t or "").encode() for _, t in corpus])[2]
    foreign = sum(r > L.FOREIGN_BITS for r in rates)
    assert kept.schema == docs.schema and kept.count() == len(corpus) - 4 - foreign and foreign < 8
    empty = docs.limit(0)
    assert L.identify(empty, L.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs, L.learn(empty)).collect()} == {"und"}


def test_sample_leaves_held_out_rows(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {t for x in L.training_sample(docs).values() for t in x}
    held = {r["text"].encode() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    others = {r["text"].encode() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert texts <= others and len(texts & (held - others)) == 0
