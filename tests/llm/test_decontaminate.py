import hashlib
import re
from collections import Counter

from celerix.llm import decontaminate as D

from .conftest import docs_of

_fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_fold))


def brute(rows, items):
    out = Counter()
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for name, body in items:
            b = words(body)
            for window in {tuple(b[k : k + 13]) for k in range(max(1, len(b) - 12))} if b else ():
                n = len(window)
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit |= set(range(k, k + n))
                        names.add(str(name))
        out[doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


def test_against_brute_force(spark, corpus):
    rows = [r for r in corpus if r[0] != 1010]
    items = [(1, rows[4][1]), (2, " ".join(rows[9][1].split()[:20])), (10, "One, TWO; three"), (3, None), (4, "..."), (5, "a b c d"), (6, " ".join((rows[3][1] + " " + rows[30][1]).split()[2:16]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):  # one block of the benchmark, then several
        found = D.contamination(docs_of(spark, rows), bench, block_bytes=block)
        assert Counter(tuple(r) for r in found.drop("full_window").collect()) == brute(rows, items)
        assert all(not r["full_window"] or r["n_hit"] >= 13 for r in found.collect())


def test_very_long_texts_and_short_items(spark):
    """A text of many segments' size, hit at its end; hits of a short item alone are no full window."""
    long = "very " * 2_000_000 + " ".join(f"t{k}" for k in range(15))
    bench = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(15))), (2, "two words")], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.contamination(docs_of(spark, [(1, long), (2, "these two words two words"), (3, "none")]), bench).collect()}
    assert got[1]["n_hit"] == 15 and got[1]["full_window"] and not got[1]["contaminated"] and got[1]["n_words"] == 2_000_015
    assert got[2]["n_hit"] == 4 and got[2]["contaminated"] and not got[2]["full_window"] and got[3]["n_items"] == 0


def test_empty_tables(spark, corpus):
    docs, bench = docs_of(spark, corpus), spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in D.contamination(docs, bench).collect())
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_segments_answer_phrases_and_proximity(spark):
    texts = [b"a b c a b d", b"", b"c x x b x x x a", b"A, b! c?"]
    segment = D.Segment.load(D.Segment.build(texts).dump())
    starts = segment.starts.tolist()
    assert segment.phrase([b"a", b"b"]).tolist() == [starts[0], starts[0] + 3, starts[3]]
    assert segment.phrase([b"a", b"z"]).tolist() == [] and segment.phrase([b"d", b"c"]).tolist() == []
    assert segment.doc_of(segment.phrase([b"c"])).tolist() == [0, 2, 3]
    docs = docs_of(spark, [(k, t.decode()) for k, t in enumerate(texts)])
    near = D.proximity_matches(D.build_index(docs), ["a", "c"], 8)
    assert sorted(tuple(r) for r in near.collect()) == [(0, 0, 2), (0, 2, 3), (2, 0, 7), (3, 0, 2)] or sorted(tuple(r) for r in near.collect()) == [(0, 2, 3), (2, 0, 7), (3, 0, 2)]
