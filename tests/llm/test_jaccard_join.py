import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from celerix.llm import jaccard_join as J

from .conftest import docs_of

_fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_fold))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r[0])
    names = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], len(sets[k]), names[root(k)] if sets[k] else r[0]) for k, r in enumerate(rows))


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_against_brute_force(spark, corpus):
    assert found(J.link_components(docs_of(spark, corpus))) == brute(corpus)


def test_tiles_of_large_buckets(spark, monkeypatch):
    """Blocks of a few sets: buckets and components are cut into many tiles, with the same links."""
    monkeypatch.setattr(J, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"g{k}" for k in range(60)]
    rows = [(k, " ".join(f"x{rng.randrange(9)}" if rng.random() < 0.02 else w for w in base)) for k in range(60)]
    got = J.link_components(docs_of(spark, rows))
    assert found(got) == brute(rows) and links_of(got) == brute_links(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_boilerplate_needs_the_deletion_neighbourhoods(spark, monkeypatch, seed):
    """Texts of a few words of their own between common lines: most signatures are busy, the links are still all found."""
    monkeypatch.setattr(J, "BUSY", 2)
    rng = random.Random(seed)
    lines = [" ".join(f"l{k}x{j}" for j in range(9)) for k in range(4)]
    rows, chains = [], []
    for k in range(120):
        if chains and rng.random() < 0.4:
            w = rng.choice(chains).split(" ")
            w[-1 - rng.randrange(3)] = f"v{k}"
        else:
            w = " ".join(rng.sample(lines, rng.choice([1, 2, 3]))).split(" ") + [f"u{k}x{j}" for j in range(rng.choice([1, 2, 4, 8]))]
        chains.append(" ".join(w))
        rows.append((k, chains[-1]))
    assert found(J.link_components(docs_of(spark, rows))) == brute(rows)


def test_pigeonhole_bound():
    """Sets that are alike differ by at most H of the smaller set's band, and H + 1 + slack segments are enough."""
    for small in range(J.LEAST, 400):
        band = int(np.searchsorted(J.FIRST, small, "right")) - 1
        for large in range(small, small * 100 // J.PERCENT + 1):
            assert (small + large) * (100 - J.PERCENT) // (100 + J.PERCENT) <= J.MOST[band]
            assert band in J.slots(np.array([large]))[1] and band in J.slots(np.array([small]))[1]


def test_parity_never_overstates_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 3000, int(rng.integers(0, 900))).astype(np.uint64)) for _ in range(2))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in J.parity(a) ^ J.parity(b))
        assert apart <= len(np.setxor1d(a, b))


def test_allocation_is_worth_enough():
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = int(rng.integers(2, 30))
        need = int(rng.integers(1, m + 1))
        exact = rng.integers(0, 50, m).astype(float)
        worth = J._allocate(m, need, exact, exact + rng.integers(0, 50, m))
        assert worth.sum() >= need and worth.max() <= 2


def test_keep_one_and_empty(spark, corpus):
    docs = docs_of(spark, corpus)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    names = {c for (_, _, c) in brute(corpus)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x in names)
    none = docs.limit(0)
    assert J.link_components(none).count() == 0 and J.keep_one(none).count() == 0


def brute_links(rows):
    """Of each row the number of other shingle sets that its own is like."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_fold))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    other = set(sets) - {frozenset()}
    return Counter((r[0], sum(t != s and 100 * len(s & t) >= 80 * len(s | t) for t in other) if s else 0) for r, s in zip(rows, sets, strict=True))


def links_of(df):
    return Counter((r["doc_id"], r["n_links"]) for r in df.collect())


def test_all_links_of_near_copies(spark, corpus):
    """A group of 40 near copies, a chain whose ends are unlike, sets of few shingles and the corpus: n_links counts every link."""
    rng = random.Random(6)
    base = [f"g{k}" for k in range(200)]
    rows = [(2000 + k, " ".join([*base[:-4], *(f"x{rng.randrange(40)}" for _ in range(rng.choice([2, 4, 12])))])) for k in range(40)]
    chain = [f"c{k}" for k in range(60)]
    for k in range(25):
        chain[k * 2] = f"d{k}"
        rows.append((3000 + k, " ".join(chain[k:])))
    rows += [(4000 + 10 * a + b, " ".join(f"s{a}x{k}" for k in range(8 + b))) for a in range(6) for b in range(4)]
    want = brute_links(rows)
    assert max(n for _, n in want) > 25
    assert links_of(J.link_components(docs_of(spark, rows))) == want
    assert links_of(J.link_components(docs_of(spark, corpus))) == brute_links(corpus)


def test_all_links_by_signatures(spark):
    """A long chain, where the signatures give fewer pairs than the component has."""
    w = [f"c{k}" for k in range(700)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(150)]
    assert links_of(J.link_components(docs_of(spark, rows))) == brute_links(rows)
