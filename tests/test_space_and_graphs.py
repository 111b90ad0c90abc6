import sys

import numpy as np
import pytest
from celerix.frame import AnnFrame
from celerix.operators import clustering, decomposition, graph, layout, neighbors, spatial


def points(spark, xy, labels=None, libs=None):
    n = len(xy)
    obs = spark.createDataFrame([(i, str(labels[i]) if labels is not None else "a", str(libs[i]) if libs is not None else "l") for i in range(n)], "obs_id long, c string, lib string")
    vec = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(xy)], "obs_id long, vec array<double>")
    x = spark.createDataFrame([(i, 0, float(p[0])) for i, p in enumerate(xy)], "obs_id long, var_id long, value double")
    return AnnFrame(obs, x.select("var_id").distinct(), x, obsm={"spatial": vec, "X_pca": vec})


def pairs(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


def lattice(side):
    return np.array([(100 * c + 50 * (r % 2), 86.6 * r) for r in range(side) for c in range(side)])


def brute_knn(xy, k, libs=None):
    out = {}
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        ok = [j for j in range(len(xy)) if j != i and (libs is None or libs[i] == libs[j])]
        for j in sorted(ok, key=lambda j: (d[j], j))[:k]:
            out[i, j] = d[j]
    return out


@pytest.mark.parametrize("dim", [2, 3])
def test_knn_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    xy = np.concatenate([rng.random((150, dim)), rng.random((30, dim)) * 0.01 + 5, [[40.0] * dim]])
    libs = np.arange(len(xy)) % 2
    got = pairs(spatial.spatial_neighbors_knn(points(spark, xy, libs=libs), 5, library_key="lib", copy=True).distances)
    want = brute_knn(xy, 5, libs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_few_points_and_large_offsets(spark):
    assert len(pairs(spatial.spatial_neighbors_knn(points(spark, np.array([[0, 0], [1, 0], [0, 3.0]])), 6, copy=True).distances)) == 6
    xy = np.array([[2e5, 2e5], [2e5 + 273, 2e5], [0, 0]])
    got = pairs(spatial.spatial_neighbors_knn(points(spark, xy), 1, copy=True).distances)
    assert got[0, 1] == got[1, 0] == 273


def test_radius_is_symmetric_and_inclusive(spark):
    xy = lattice(8)
    got = pairs(spatial.spatial_neighbors_radius(points(spark, xy), 100.0, copy=True).distances)
    assert all((b, a) in got and d <= 100 for (a, b), d in got.items())
    assert sum(1 for i, _ in got if i == 27) >= 4 and (0, 1) in got


def test_rings_and_diagonal(spark):
    got = spatial.spatial_neighbors_grid(points(spark, lattice(8)), n_rings=2, set_diag=True, copy=True)
    ring = pairs(got.distances)
    assert set(ring.values()) == {1.0, 2.0} and sum(1 for (a, _), r in ring.items() if a == 27 and r == 2) == 12
    assert (3, 3) in pairs(got.connectivities)


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(0)
    xy = rng.random((60, 2))
    edges = spatial.triangulate(xy)
    at = {i: set() for i in range(60)}
    for a, b in edges:
        at[a].add(b)
        at[b].add(a)
    triangles = {tuple(sorted((a, b, c))) for a, b in edges for c in at[a] & at[b]}
    empty = 0
    for a, b, c in triangles:
        m = np.array([xy[b] - xy[a], xy[c] - xy[a]])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        u = np.linalg.solve(2 * m, (m**2).sum(1))
        d = ((xy - xy[a] - u) ** 2).sum(1)
        empty += (d < (u**2).sum() - 1e-9).sum() == 0
    hull_and_inner = 3 * 60 - 3 - len(edges)  # edges of a triangulation are 3n - 3 - hull
    assert 3 <= hull_and_inner <= 30 and empty >= 2 * 60 - 2 - hull_and_inner


def test_moran_signs_and_permutation_p(spark):
    side = 10
    xy = lattice(side)
    r, c = np.divmod(np.arange(side * side), side)
    frame = points(spark, xy)
    rows = [(int(i), k, float(v[i])) for k, v in enumerate([r * 1.0, (r % 2) * 1.0]) for i in range(side * side)]
    x = spark.createDataFrame(rows, "obs_id long, var_id long, value double")
    frame = AnnFrame(frame.obs, x.select("var_id").distinct(), x, obsm=frame.obsm)
    frame = spatial.spatial_neighbors_radius(frame, 101.0)
    got = {q["var_id"]: q for q in spatial.spatial_autocorr(frame, n_perms=19).collect()}
    assert got[0]["I"] > 0.7 and got[1]["I"] < 0 and got[0]["pval_sim"] == 1 / 20 and got[0]["pval_norm_fdr_bh"] < 1e-6
    with pytest.raises(ValueError):
        spatial.spatial_autocorr(frame, "join")


def test_communities_of_cliques(spark):
    rows = [(10 * k + a, 10 * k + b, 1.0) for k in range(4) for a in range(6) for b in range(6) if a != b]
    rows += [(10 * k, 10 * k + 10, 1.0) for k in range(3)] + [(10 * k + 10, 10 * k, 1.0) for k in range(3)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    for comm in (graph.louvain_communities(edges), graph.leiden_communities(edges)):
        label = {r["id"]: r["comm"] for r in comm.collect()}
        assert len({label[10 * k] for k in range(4)}) == 4 and all(label[10 * k + a] == label[10 * k] for k in range(4) for a in range(6))
    ids = edges.selectExpr("src as id").distinct()
    comp = {r["id"]: r["comp"] for r in graph.components(edges.filter("src div 10 = dst div 10"), ids).collect()}
    assert set(comp.values()) == {0, 10, 20, 30}
    colour = {r["id"]: r["colour"] for r in graph.colouring(edges, ids).collect()}
    assert all(colour[a] != colour[b] for a, b, _ in rows)


def test_fuzzy_graph_invariants(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, (60, 5)), np.zeros((3, 5))])
    frame = neighbors.neighbors(points(spark, v), 8)
    w = pairs(frame.obsp["connectivities"])
    assert all(abs(w[b, a] - x) < 1e-12 and 0 < x <= 1 for (a, b), x in w.items())
    assert frame.obsp["distances"].groupBy("src").count().filter("count <> 7").isEmpty()
    bb = neighbors.bbknn(points(spark, v, libs=np.arange(63) % 3), "lib")
    assert not bb.obsp["connectivities"].isEmpty()


def test_approximate_neighbours_recall(spark):
    v = np.random.default_rng(0).normal(0, 1, (400, 6))
    vecs = points(spark, v).obsm["X_pca"]
    want = {(r["obs_id"], r["nbr_id"]) for r in neighbors.exact_knn(vecs, 8).collect()}
    assert want == {k for k in brute_knn(v, 8)}
    got = {(r["obs_id"], r["nbr_id"]) for r in neighbors.nn_descent(vecs, 8).collect()}
    assert len(want & got) > 0.9 * len(want)
    cells = {(r["obs_id"], r["nbr_id"]) for r in neighbors.ivf_knn(vecs, 8).collect()}  # two cells, both searched
    assert cells == want


def test_pca_and_kmeans_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, (120, 6)) * [5, 3, 1, 1, 1, 0.5] + 4
    vecs = points(spark, v).obsm["X_pca"]
    scores, _, variance, ratio = decomposition.pca_vectors(vecs, 3)
    z = v - v.mean(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["vec"] for r in sorted(scores.collect(), key=lambda r: r["obs_id"])])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6) and np.allclose(variance, s[:3] ** 2 / 119)
    assert abs(ratio.sum() - (s[:3] ** 2).sum() / (s**2).sum()) < 1e-9
    blobs = np.concatenate([rng.normal(m, 0.1, (40, 2)) for m in (0, 5, 10)])
    label = {r["obs_id"]: r["label"] for r in clustering.kmeans_labels(points(spark, blobs).obsm["X_pca"], 3).collect()}
    assert len({tuple(label[i + 40 * k] for i in range(40)) for k in range(3)}) == 3 and all(len({label[i + 40 * k] for i in range(40)}) == 1 for k in range(3))


def test_harmony_mixes_batches(spark):
    rng = np.random.default_rng(0)
    kind, batch = np.arange(300) % 2, (np.arange(300) // 2) % 2
    v = rng.normal(0, 0.5, (300, 8))
    v[:, 0] += np.where(kind, 3, -3)
    v[:, 1] += 2.0 * batch
    frame = decomposition.harmony_integrate(points(spark, v, libs=batch), "lib", n_clusters=6)
    before = neighbors.ilisi(frame.obsm["X_pca"], frame.obs.select("obs_id", "lib"), 20).agg({"lisi": "avg"}).first()[0]
    after = neighbors.ilisi(frame.obsm["X_pca_harmony"], frame.obs.select("obs_id", "lib"), 20).agg({"lisi": "avg"}).first()[0]
    assert after > before + 0.15


def test_layouts_separate_blobs(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.3, (40, 4)), rng.normal(6, 0.3, (40, 4))])
    frame = neighbors.neighbors(points(spark, v), 8)
    for key, out in (("X_umap", layout.umap(frame, n_epochs=60)), ("X_tsne", layout.tsne(frame, n_iter=150, perplexity=10)), ("X_draw_graph_fa", layout.draw_graph(frame, n_iter=40))):
        y = np.array([r["vec"] for r in sorted(out.obsm[key].collect(), key=lambda r: r["obs_id"])])
        assert np.isfinite(y).all()
        a, b = y[:40].mean(0), y[40:].mean(0)
        inside = max(np.sqrt(((y[:40] - a) ** 2).sum(1)).mean(), np.sqrt(((y[40:] - b) ** 2).sum(1)).mean())
        assert np.sqrt(((a - b) ** 2).sum()) > inside, key
    with pytest.raises(ValueError):
        layout.draw_graph(frame, "spiral")
    evals = decomposition.diffmap(neighbors.neighbors(points(spark, v[:40]), 8), 5).uns["diffmap_evals"]
    assert abs(evals[0] - 1) < 0.2 and all(x >= y - 1e-9 for x, y in zip(evals, evals[1:], strict=False))


def test_moran_pvalues_of_every_component(spark, sf):
    """All components are tested, and corrected together."""
    from celerix.plans import registry

    width = len(spark.read.parquet(f"{sf}/embeddings.parquet").first()["embedding"])
    assert sorted(r["var_id"] for r in registry.QUERIES["moran_pvalues"](spark, sf).collect()) == list(range(width)) and width > 8


@pytest.mark.parametrize(("name", "module", "limits"), [("tsne", "layout", {"n_iter"}), ("umap", "layout", {"n_epochs", "maxiter"}), ("draw_graph", "layout", {"n_iter"}), ("harmony", "decomposition", {"rounds", "inner"})])
def test_registered_queries_run_all_iterations(spark, sf, monkeypatch, name, module, limits):
    """No query asks for fewer iterations than its operator's default."""
    from celerix.plans import registry  # before the modules that it loads
    iterative = sys.modules["celerix.plans.iterative"]

    class Called(Exception):
        pass

    def operator(*args, **named):
        raise Called(set(named))

    monkeypatch.setattr(getattr(iterative, module), "harmony_integrate" if name == "harmony" else name, operator)
    with pytest.raises(Called) as call:
        registry.QUERIES[name](spark, sf)
    assert not call.value.args[0] & limits
