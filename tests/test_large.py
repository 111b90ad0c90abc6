"""Steps that scale: each test would fail, or not end, on the code before."""

import numpy as np
import pytest
from celerix.operators import clustering, neighbors

from .test_space_and_graphs import brute_knn, points


def found(df):
    return {(r["obs_id"], r["nbr_id"]): r["dist"] for r in df.collect()}


def test_exact_search_over_several_blocks(spark, monkeypatch):
    """Blocks, offsets that single precision cannot hold, and points that coincide; ties go to the least id."""
    monkeypatch.setattr(neighbors, "ROWS", 64)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(0, 1, (300, 5)) + 1e6, np.zeros((40, 5))])
    frame = points(spark, v, libs=np.arange(len(v)) % 2)
    got, want = found(neighbors.exact_knn(frame.obsm["X_pca"], 7)), brute_knn(v, 7)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    part = neighbors.exact_knn(frame.obsm["X_pca"], 3, by=neighbors.batch_label(frame, "lib")).collect()
    assert len(part) == len(v) * 2 * 3 and all((r["nbr_id"] % 2 == 1) == (r["part"] == "1") for r in part)


def test_search_shuffles_candidates_only(spark):
    """The blocks of queries and points meet where they are: no exchange between the meeting and the search."""
    v = np.random.default_rng(0).normal(0, 1, (50, 3))
    plan = neighbors.exact_knn(points(spark, v).obsm["X_pca"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "RoundRobin" not in plan


def test_neighbours_do_not_depend_on_the_number_of_rows(spark):
    """Over 30 000 rows the search was approximate."""
    n = 30_001
    vecs = spark.range(n).selectExpr("id as obs_id", "array(cast(id as double), 0D) as vec")
    got = {(r["obs_id"], r["nbr_id"]) for r in neighbors.knn(vecs, 2).collect()}
    assert got == {(i, i + s) for i in range(1, n - 1) for s in (-1, 1)} | {(0, 1), (0, 2), (n - 1, n - 2), (n - 1, n - 3)}


def test_inverted_file_search_meets_in_blocks(spark):
    """No pair of vectors is joined row by row, and a row's five cells together give its nearest ones there."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(4 * m, 0.1, (40, 3)) for m in range(3)])
    vecs = points(spark, v).obsm["X_pca"]
    out = neighbors.ivf_knn(vecs, 5)
    assert "zip_with" not in out._jdf.queryExecution().analyzed().toString()
    assert found(out).keys() == brute_knn(v, 5).keys()


def test_kmeans_reads_its_input_once(spark):
    """The iterations run over stored blocks, not over the plan of the vectors."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    v = np.concatenate([np.random.default_rng(0).normal(m, 1.0, (60, 2)) for m in (0, 2, 4)])
    vecs = points(spark, v).obsm["X_pca"].mapInArrow(count, "obs_id long, vec array<double>")
    centres = clustering.kmeans_centres(vecs, 3)
    assert seen.value <= 3 * len(v) and centres.shape == (3, 2)
    label = ((v[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(centres, [v[label == k].mean(0) for k in range(3)])


@pytest.mark.parametrize("goal", [3, 15])
def test_bandwidths_of_whole_batches(goal):
    d = np.sort(np.random.default_rng(goal).random((20, 14)), axis=1)
    d[0] = 0
    rho, sigma = neighbors._smooth(d, np.log2(goal))
    total = np.exp(-np.maximum(0, d - rho[:, None]) / sigma[:, None]).sum(1)
    assert np.allclose(total[1:], np.log2(goal), atol=1e-4) and rho[0] == 0


def test_harmony_runs_all_inner_sweeps(spark, monkeypatch):
    """Half of the inner sweeps were left out; a round ends early only when the shares have settled."""
    from celerix.operators import decomposition

    ran = []
    real = decomposition.summed
    monkeypatch.setattr(decomposition, "summed", lambda *a: ran.append(a) or real(*a))
    monkeypatch.setattr(decomposition, "SETTLED", -1.0)
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.5, (120, 4)) + np.where(np.arange(120) % 2, 2, -2)[:, None]
    decomposition.harmony_integrate(points(spark, v, libs=np.arange(120) // 2 % 2), "lib", n_clusters=3, rounds=1, inner=6)
    assert len(ran) == 6 + 1


@pytest.fixture
def small_leaves(monkeypatch):
    from celerix.operators import spatial

    monkeypatch.setattr(spatial, "LEAF", 32)
    return spatial


def scattered():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(0, 0.01, (100, 2)) + 5, np.full((50, 2), 2.0), [[400.0, -300.0]]])


def test_spatial_search_over_several_leaves(spark, small_leaves):
    xy = scattered()
    libs = np.arange(len(xy)) % 2
    df = small_leaves.spatial_neighbors_knn(points(spark, xy, libs=libs), 5, library_key="lib", copy=True).distances
    got, want = {(r["src"], r["dst"]): r["weight"] for r in df.collect()}, brute_knn(xy, 5, libs)
    assert got == want
    near = {(r["src"], r["dst"]) for r in small_leaves.spatial_neighbors_radius(points(spark, xy), (0.02, 0.5), copy=True).distances.collect()}
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    assert near == {(i, j) for i, j in zip(*np.nonzero((d >= 0.02) & (d <= 0.5)), strict=True) if i != j}


def test_no_task_searches_a_library_for_one_row(spark, small_leaves, monkeypatch):
    """Rows that their cell did not settle were searched over all points."""
    from celerix.operators import neighbors

    monkeypatch.setattr(neighbors, "exact_knn", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(small_leaves, "exact_knn", lambda *a, **b: 1 / 0, raising=False)
    assert small_leaves.spatial_neighbors_knn(points(spark, scattered()), 5, copy=True).distances.count() == 451 * 5


def test_co_occurrence_counts_by_blocks(spark, small_leaves):
    xy, label = scattered(), np.arange(451) % 3
    label = np.where(np.arange(451) % 7 == 0, 9, label)
    limits = [0.0, 0.3, 5.0, 600.0]
    pts = points(spark, xy, labels=label)
    got = {(r["cc"], r["ci"], r["bin"]): r["n"] for r in small_leaves._pair_histogram(small_leaves.coords(pts).join(pts.obs.select("obs_id", "c"), "obs_id"), limits).collect()}
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    place = np.searchsorted(limits, d)
    np.fill_diagonal(place, 9)
    want = {(str(a), str(b), k): int((place[label == a][:, label == b] == k).sum()) for a in set(label.tolist()) for b in set(label.tolist()) for k in range(4)}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("mode", ["moran", "geary"])
def test_permuted_autocorrelation_against_numpy(spark, small_leaves, mode):
    """Values travel as arrays of a row, and a permutation meets a row's lag, not its edges."""
    from celerix.functions.stats import permutations

    rng = np.random.default_rng(1)
    xy = rng.random((90, 2))
    frame = small_leaves.spatial_neighbors_knn(points(spark, xy), 4)
    v = rng.normal(0, 1, (90, 70))
    x = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(90) for j in range(70)], "obs_id long, var_id long, value double")
    frame = type(frame)(frame.obs, x.select("var_id").distinct(), x, obsp=frame.obsp)
    got = {r["var_id"]: r for r in small_leaves.spatial_autocorr(frame, mode, n_perms=5, with_p=False, corr_method=None).collect()}
    w = np.zeros((90, 90))
    for r in frame.obsp["spatial_connectivities"].collect():
        w[r["src"], r["dst"]] = 0.25
    z = v - v.mean(0)
    figure = (lambda a: 90 / w.sum() * np.einsum("ij,ik,jk->k", w, a, z) / (z**2).sum(0)) if mode == "moran" else (lambda a: 89 / (2 * w.sum()) * (w[..., None] * (a[:, None] - z[None]) ** 2).sum((0, 1)) / (z**2).sum(0))
    sims = []
    moved = permutations(frame.obs.select("obs_id"), 5, 0).collect()
    for k in range(5):
        to = {r["id"]: r["new_id"] for r in moved if r["perm_id"] == k}
        sims.append(figure(z[[to[i] for i in range(90)]]))
    name = "I" if mode == "moran" else "C"
    assert np.allclose([got[j][name] for j in range(70)], figure(z)) and np.allclose([got[j]["var_sim"] for j in range(70)], np.var(sims, axis=0))


def test_components_of_a_long_path(spark):
    """Trees of pointers become vertices: the rounds grow with the logarithm, and names are the least ids."""
    from celerix.operators import graph

    rng = np.random.default_rng(0)
    at = rng.permutation(300)
    rows = [(int(a), int(b)) for a, b in zip(at[:199], at[1:200], strict=True)] + [(int(a), int(b)) for a, b in zip(at[200:298], at[201:299], strict=True)]
    edges, ids = spark.createDataFrame(rows, "src long, dst long"), spark.range(300)
    comp = {r["id"]: r["comp"] for r in graph.components(edges, ids).collect()}
    want = {int(v): int(at[part].min()) for part in (slice(0, 200), slice(200, 299), slice(299, 300)) for v in at[part]}
    assert comp == want


def test_tsne_repulsion_holds_no_matrix_of_all_pairs():
    import tracemalloc

    from celerix.operators import layout

    y = np.random.default_rng(0).normal(0, 1, (3000, 2))
    tracemalloc.start()
    push, total = layout.repulsion(y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    diff = y[:500, None] - y[None]
    q = 1 / (1 + (diff**2).sum(2))
    q[np.arange(500), np.arange(500)] = 0
    assert np.allclose(push[:500], (q[..., None] ** 2 * diff).sum(1)) and peak < 8 * 3000 * 3000
    assert abs(total - (1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))).sum() + 3000) < 1e-6 * total
