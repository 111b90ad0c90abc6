import math
import re

from celerix.llm import mixing as M

from .conftest import docs_of


def test_targets_stop_and_reshare():
    assert M.targets_of([10, 10, 10], [5, 2, 1], 30) == [18.75, 7.5, 3.75]
    out = M.targets_of([1, 50, 49], [5, 2, 1], 100)
    assert out[0] == 3 and math.isclose(sum(out), 100) and math.isclose(out[1], 2 * out[2])
    assert M.targets_of([0, 10], [5, 2], 10) == [0, 10]
    assert M.targets_of([], [], 0) == []


def test_mix(spark, corpus):
    rows = [(r[0], r[1], "en", [None, "a", "b", "é"][k % 4]) for k, r in enumerate(corpus)]
    docs = docs_of(spark, rows)
    got = M.mixture(docs).collect()
    again = sorted((tuple(r) for r in M.mixture(docs.repartition(7)).collect()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == again
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert len(got) == len(rows) and all(r["size"] == size[r["doc_id"]] for r in got)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    by = {}
    for doc, _, _, source in rows:
        by.setdefault(source, []).append(size[doc])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = M.targets_of([float(sum(by[s])) for s in order], [5, 2, 1, 5], float(sum(map(sum, by.values()))))
    totals = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert totals == {(sum(by[s]), round(t, 6)) for s, t in zip(order, want, strict=True)}
    for s, t in zip(order, want, strict=True):
        taken = sum(r["taken"] for r in got if (r["source_size"], round(r["target"], 6)) == (sum(by[s]), round(t, 6)))
        assert abs(taken - t) <= 0.02 * t + 60


def test_dual_meets_crossed_constraints(spark):
    """Two keys at once: the multipliers add, and both sets of sums are met."""
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 40.0)], "s string, l string, words double")
    one, two = M.solve_dual(cells, ["s", "l"], [{"a": 60.0, "b": 40.0}, {"x": 50.0, "y": 50.0}])
    mass = {(s, l): w * math.exp(one[s] + two[l]) for s, l, w in [("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40)]}
    assert abs(mass["a", "x"] + mass["a", "y"] - 60) < 1e-6 and abs(mass["a", "x"] + mass["b", "x"] - 50) < 1e-6


def test_rates_against_a_brute_force_dual(spark, corpus):
    """A plain fixed-point iteration over documents gives the same rates: sources exactly, bands damped; rates differ within a source."""
    rows = [(r[0], r[1], "en", "abc"[k % 3]) for k, r in enumerate(corpus) if r[0] not in (None, 1010, 1011)]
    got = M.mixture(docs_of(spark, rows)).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in "abc"}
    goal = dict(zip("abc", M.targets_of([float(own[s]) for s in "abc"], [5, 2, 1], float(sum(size))), strict=True))
    band = [n.bit_length() - 1 for n in size]
    share = {b: sum(n for n, x in zip(size, band, strict=True) if x == b) for b in set(band) if b >= 0}
    one, two = dict.fromkeys("abc", 0.0), dict.fromkeys(share, 0.0)
    for _ in range(3000):
        mass = [n * math.exp(one[r[3]] + two[b]) if n else 0.0 for n, r, b in zip(size, rows, band, strict=True)]
        for s in "abc":
            one[s] += math.log(goal[s] / sum(m for m, r in zip(mass, rows, strict=True) if r[3] == s))
        mass = [n * math.exp(one[r[3]] + two[b]) if n else 0.0 for n, r, b in zip(size, rows, band, strict=True)]
        for b, w in share.items():
            two[b] -= 0.5 * (sum(m for m, x in zip(mass, band, strict=True) if x == b) + M.RIDGE * w * two[b] - w) / (w * (1 + M.RIDGE))
    want = {r[0]: math.exp(one[r[3]] + two[b]) for r, b, n in zip(rows, band, size, strict=True) if n}
    stopped = {r[3] for r in rows if want.get(r[0], 0) > 3}  # there the rates stop at 3, and the others rise
    assert len(stopped) < 3
    for r in got:
        if r["size"] and r["source"] not in stopped:
            assert abs(r["rate"] - want[r["doc_id"]]) < 1e-3 * want[r["doc_id"]]
        assert r["rate"] <= 3
    for s in "abc":
        assert abs(sum(r["rate"] * r["size"] for r in got if r["source"] == s) - goal[s]) < 1e-6 * goal[s]
    assert max(len({round(r["rate"], 6) for r in got if r["source"] == s and r["size"]}) for s in "abc") > 2


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "one two three", "en", "a")] * 6 + [(2, "four five six seven", "en", "b"), (None, "x y", "en", "a"), (None, "x y", "en", None)]
    docs = docs_of(spark, rows).selectExpr("*", "'q' as _id", "1 as copies", "2 as rows", "3 as hash", "4 as id", "5 as times", "6 as number", "7 as row")
    plan = {}
    for r in M.mixture(docs).collect():
        key = (r["doc_id"], r["source"])
        plan[key] = plan.get(key, 0) + r["copies"]
    got = {}
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        key = (r["doc_id"], r["source"])
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_rows_and_empty(spark, corpus):
    docs = docs_of(spark, [(r[0], r[1], "en", "ab"[k % 2]) for k, r in enumerate(corpus) if r[0] is not None and r[0] != 1011])
    copies = {r["doc_id"]: r["copies"] for r in M.mixture(docs).collect()}
    rows = M.mixed_rows(docs)
    assert rows.columns == docs.columns
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert M.mixture(docs.limit(0)).count() == 0 and M.mixed_rows(docs.limit(0)).count() == 0
