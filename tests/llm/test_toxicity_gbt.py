import zlib

import numpy as np
from celerix.llm import toxicity_gbt as X

from .conftest import docs_of


def test_isotonic_is_monotone_and_pools():
    rng = np.random.default_rng(0)
    m = rng.standard_normal(500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * m))).astype(int)
    at, share = X.isotonic(m, y)
    assert (np.diff(at) >= 0).all() and (np.diff(share) >= -1e-12).all() and share[0] < 0.2 < 0.8 < share[-1]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(X.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    p = X.Trees(x[:2000], y[:2000], rate=0.3).margin(x[2000:]) > 0
    assert (p == y[2000:]).mean() > 0.9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.toxicity(docs, X.learn(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()
    a, b = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()) if len(a) else 1
    assert auc > 0.75
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_features():
    words = X.Words({"zork", "grmb~"}, {"meh"})
    x = dict(zip(X.FEATURES, X.features([b"You ZORK! z0rk grmbling meh"], words)[0], strict=True))
    assert x["near_person"] > 0 and x["unmasked"] == 0.2 and x["caps_words"] == 0.2 and x["weak"] > 0 and x["exclamation"] == 0.2
    assert not X.features([b"", b" \n"], words).any()


def test_lexica_against_plain_counts():
    """Each fold's lexicon is that of the other folds' rows, counted form by form."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("zor", "gim", "pla") for b in ("kel", "mon", "ti") for c in ("", "da", "ri", "so")]
    texts = [" ".join(rng.choice(words[:12] if toxic else words[6:], 6)).encode() for toxic in [1, 0, 0] * 60]
    y, fold = np.array([1, 0, 0] * 60), rng.integers(0, X.FOLDS, 180)
    got = X.lexica(texts, y, fold)
    for own in range(X.FOLDS + 1):
        rows = [k for k in range(180) if fold[k] != own]
        want = {1: set(), 0: set()}
        for f in {f for k in rows if y[k] for f in X.forms(texts[k])}:
            t, c = (sum(f in X.forms(texts[k]) for k in rows if y[k] == v) for v in (1, 0))
            n, m = (sum(int(y[k]) == v for k in rows) for v in (1, 0))
            odds = np.log((t + 0.5) / (n - t + 0.5)) - np.log((c + 0.5) / (m - c + 0.5))
            if t >= X.LEAST_TEXTS and odds > 1.5:
                want[int(odds > 3)].add(f)
        assert got[own] == (want[1], want[0]) and want[1]


def test_first_split_against_brute_force():
    """The root of the first tree gains as much as the best of all cuts tried one by one."""
    rng = np.random.default_rng(4)
    x = rng.random((300, len(X.FEATURES))).round(2)
    y = (x[:, 5] + 0.3 * rng.random(300) > 0.7).astype(int)
    tree = X.Trees(x, y, trees=1, depth=1)
    p = y.mean()

    def gain(j, c):
        total = 0.0
        for side in (x[:, j] <= c, x[:, j] > c):
            total += (p - y[side]).sum() ** 2 / (side.sum() * p * (1 - p) + 1)
        return total

    best = max(gain(j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j]))
    assert tree.feature[0][0] == 5 and gain(int(tree.feature[0][0]), tree.cut[0][0]) > 0.95 * best


def test_few_labels_are_learned_from(spark):
    rows = [(k, ["you are kind and good", "you zorkish grumph idiot"][k % 2] + f" w{k}") for k in range(25)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(25)], "doc_id long, quality int, toxic int")
    got = X.toxicity(docs_of(spark, rows), X.learn(docs_of(spark, rows), labels)).collect()
    toxic, clean = ([r["score"] for r in got if r["doc_id"] % 2 == v] for v in (1, 0))
    assert min(toxic) > max(clean)


def test_edges(spark, corpus):
    docs = docs_of(spark, corpus)
    labels = spark.createDataFrame([(r[0], 1, int(k % 2)) for k, r in enumerate(corpus)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = X.toxicity(docs, X.learn(docs, labels)).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    none = X.learn(docs, labels.limit(0))
    assert {r["score"] for r in X.toxicity(docs, none).collect()} == {0.5}
    assert X.toxicity(docs.limit(0), none).count() == 0
