import hashlib
import random
from collections import Counter

import numpy as np
from celerix.llm import relative_lz as R

from .conftest import docs_of


def split(text):
    return (text or "").encode().split()


def brute(rows):
    count = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [split(t)] for k in range(len(w) - 34))
    out = Counter()
    for doc, text in rows:
        w = split(text)
        covered = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                covered[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[doc, len(w), sum(covered), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_against_brute_force(spark, corpus):
    assert Counter(tuple(r) for r in R.removal(docs_of(spark, corpus)).collect()) == brute(corpus)


def test_overlapping_factors_few_words(spark):
    """Texts over two words repeat in every way; passages straddle and nest."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") if rng.random() < 0.3 else "a" for _ in range(rng.choice([34, 35, 36, 70, 120])))) for k in range(40)]
    base = [f"p{k}" for k in range(120)]
    for k in range(30):
        a = rng.randrange(100)
        rows.append((100 + k, " ".join([f"q{k}", *base[a : a + rng.choice([34, 35, 40, 60])], f"r{k}", *base[: rng.choice([10, 35, 50])]])))
    assert Counter(tuple(r) for r in R.removal(docs_of(spark, rows)).collect()) == brute(rows)


def test_kept_text_and_empty(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = docs_of(spark, [(1, f"a {passage} b"), (2, f"{passage} c"), (3, "d  e\nf")])
    assert {r["doc_id"]: r["kept"] for r in R.remove_copies(docs).collect()} == {1: "a b", 2: "c", 3: "d e f"}
    assert R.removal(docs.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    text = np.concatenate([rng.integers(0, 1 << 63, 50).astype(np.uint64), words, rng.integers(0, 1 << 63, 30).astype(np.uint64), words])
    _, anchor, _, a, b = R.contexts(R.Prefixes(text), np.array([0, len(text)]))
    of = {s: int(x) for x, lo, hi in zip(anchor, a, b, strict=True) for s in range(lo, hi + 1)}
    assert sorted(of) == list(range(len(text) - 34))
    assert [of[50 + k] for k in range(6)] == [of[120 + k] for k in range(6)]
