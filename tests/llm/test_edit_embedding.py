import hashlib
import random

import numpy as np
import pytest
from celerix.llm import edit_embedding as E

from .conftest import docs_of


def slow_walk(text):
    """The embedding step by step: where each character is first stood on."""
    step, out = 0, []
    for c in text:
        out.append(step)
        cls = (np.uint32(ord(c)) * np.uint32(2654435761) >> np.uint32(24)).item()
        while not E._moves[cls, step % E.PERIOD]:
            step += 1
        step += 1
    return out


def test_walks_step_by_step():
    texts = ["", "a", "hello wörld 語" * 50, "zz" * 3000]
    codes = [E._codes(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    with np.errstate(over="ignore"):
        got = E.walks(np.concatenate(codes), bounds)
        for k, t in enumerate(texts):
            assert got[bounds[k] : bounds[k + 1]].tolist() == slow_walk(t)


def test_query_against_plain_rows(spark, corpus):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    plain = [r for r in rows if r[0] != 1011]
    got = {r["doc_id"]: r for r in E.fingerprint_edits(docs_of(spark, plain)).collect()}
    assert len(got) == len(plain)
    for k, (doc, text) in enumerate(plain):
        text, following = text or "", plain[(k + 1) % len(plain)][1] or ""
        r = got[doc]
        n = len(text)
        changed = text[: n - n // 4] + following[: n // 4]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        one, two, three = E.fingerprints_of([text, changed, following])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (one, two)
        assert abs(r["near_edited"] - E.likeness(one, two)) < 1e-12 and abs(r["near_next"] - E.likeness(one, three)) < 1e-12
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3
    docs = docs_of(spark, corpus)
    assert E.fingerprint_edits(docs).count() == len(corpus) and E.fingerprint_edits(docs.limit(0)).count() == 0
    single = E.fingerprint_edits(docs_of(spark, [(4, "only one here")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in single] == [(4, 1.0)]


def test_pairs_are_verified(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t[:300] + "X" + t[301:]) for k, t in enumerate(base)] + [(200, base[0])]
    got = {(r["a"], r["b"]): r["distance"] for r in E.near_pairs(docs_of(spark, rows)).collect()}
    assert sum(got.get((k, 100 + k)) == 1 for k in range(12)) >= 11 and len(got) <= 14


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        d = slow(a, b)
        assert E.edit_distance(a, b, 9) == d and (d == 0 or E.edit_distance(a, b, d - 1) is None)


def test_a_group_of_many_near_copies_gives_all_its_pairs(spark, monkeypatch):
    """30 near copies, a text under a used id and two without: every pair with an equal band is found, in blocks or not."""
    rng = random.Random(3)
    base = [rng.choice("abcdefgh ") for _ in range(500)]
    rows = [(k, "".join(rng.choice("xyz") if rng.random() < 0.012 else c for c in base)) for k in range(30)]
    rows += [(3, "".join(base)), (None, "".join(base[:-3])), (None, "".join(base[2:])), (40, rows[7][1]), (50, "".join(rng.choice("abcdefgh ") for _ in range(500))), (51, ""), (52, None)]
    texts = sorted({t for _, t in rows if t})
    name = {t: min((d for d, u in rows if u == t and d is not None), default=None) for t in texts}
    bands = {t: set(E.bands_of(E.fingerprints_of([t])[0])) for t in texts}
    want = []
    for i, x in enumerate(texts):
        for y in texts[:i]:
            d = E.edit_distance(x, y, int(0.05 * max(len(x), len(y)))) if bands[x] & bands[y] else None
            if d is not None:
                want.append((*sorted((name[x], name[y]), key=lambda v: (v is not None, v or 0)), d))
    order = lambda rs: sorted(rs, key=str)
    assert len(want) > 400
    for block in (512, 5):
        monkeypatch.setattr(E, "BLOCK", block)
        assert order(tuple(r) for r in E.near_pairs(docs_of(spark, rows)).collect()) == order(want)


def test_gram_count_rules_out_no_near_text():
    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60)))
        y = "".join(c for c in x if rng.random() > 0.05) + rng.choice(["", "a", "bc"])
        d = E.edit_distance(x, y, 100)
        assert not E.few_grams_shared(E._codes(x), E._codes(y), d)


@pytest.mark.parametrize(("length", "edits"), [(300, 7), (600, 15), (3000, 30)])
def test_recall_against_brute_force(spark, length, edits):
    """Clusters of texts up to the limit apart (edits from a common text each, so twice as many between two)."""
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    rows, near = [], set()
    for c in range(4):
        base = [rng.choice(letters) for _ in range(length)]
        for k in range(8):
            t = list(base)
            for _ in range(rng.randrange(1, edits + 1)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = [rng.choice(letters)] if rng.random() < 0.7 else []
            rows.append((100 * c + k, "".join(t)))
    for a, x in rows:
        for b, y in rows:
            if a < b and E.edit_distance(x, y, int(0.05 * max(len(x), len(y)))) is not None:
                near.add((a, b))
    got = {(r["a"], r["b"]) for r in E.near_pairs(docs_of(spark, rows)).collect()}
    assert got <= near and len(got) >= 0.9 * len(near) > 50
