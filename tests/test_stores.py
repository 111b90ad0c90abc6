import gzip

import numpy as np
import pytest
from celerix.operators import validation
from celerix.sources import store

from celerix.frame import AnnFrame


def entries(x):
    return {(r["obs_id"], int(r["var_id"])): r["value"] for r in x.collect()}


def test_matrix_market(spark, tmp_path):
    lines = ["%%MatrixMarket matrix coordinate real general", "% made by hand", "", "4 3 3", "1 1 2.5", "4 3 3", "1 1 0.5", "2 3 -1"]
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write("\n".join(lines))
    frame = store.convert(spark, str(tmp_path / "m.mtx.gz"), str(tmp_path / "out"))
    assert entries(frame.x) == {(0, 0): 3.0, (3, 2): 3.0, (1, 2): -1.0}  # an entry that reads like the size line stays
    assert (frame.n_obs, frame.var.count()) == (4, 3)
    turned = store.read_matrix_market(spark, str(tmp_path / "m.mtx.gz"), transpose=True)
    assert entries(turned.x) == {(0, 0): 3.0, (2, 3): 3.0, (2, 1): -1.0} and (turned.n_obs, turned.var.count()) == (3, 4)


def test_matrix_market_kinds(spark, tmp_path):
    def read(kind, *rows):
        at = tmp_path / f"{kind.replace(' ', '_')}.mtx"
        at.write_text(f"%%MatrixMarket matrix {kind}\n" + "\n".join(rows))
        return store.read_matrix_market(spark, str(at))

    assert entries(read("coordinate pattern symmetric", "3 3 2", "2 1", "3 3").x) == {(1, 0): 1, (0, 1): 1, (2, 2): 1}
    assert entries(read("coordinate integer skew-symmetric", "2 2 1", "2 1 5").x) == {(1, 0): 5, (0, 1): -5}
    empty = read("coordinate real general", "2 2 0")
    assert entries(empty.x) == {} and empty.n_obs == 2
    for kind in ("array real general", "coordinate complex general"):
        with pytest.raises(ValueError):
            read(kind, "1 1", "1")


def test_convert_materialize_and_transformed(spark, tmp_path):
    rows = [(k, str(j), float(k + j)) for k in range(5) for j in range(4)]
    spark.createDataFrame([*rows, (9, "0", 0.0)], "obs_id long, var_id string, value double").write.option("header", True).csv(str(tmp_path / "m.csv"))
    frame = store.convert(spark, str(tmp_path / "m.csv"), str(tmp_path / "store"))
    want = {(k, int(j)): v for k, j, v in rows if v}
    assert entries(frame.x) == want and frame.n_obs == 6
    doubled = AnnFrame(frame.obs, frame.var, frame.x.selectExpr("obs_id", "var_id", "2 * value as value"))
    assert entries(store.materialize(doubled, str(tmp_path / "kept")).x) == {k: 2 * v for k, v in want.items()}
    store.write_transformed(doubled, str(tmp_path / "twice"))
    assert entries(store.open_store(spark, str(tmp_path / "twice")).x) == {k: 2 * v for k, v in want.items()}
    doubled.uns["scaled"] = True
    with pytest.raises(ValueError):
        store.write_transformed(doubled, str(tmp_path / "never"))
    assert store.auto_block_rows(1 << 30) == 1 and store.auto_block_rows(10) == 100_000


def test_blocks_in_order(spark):
    x = spark.createDataFrame([(0, 1, 2.0), (0, 0, 1.0), (7, 3, 4.0)], "obs_id long, var_id int, value double")
    assert [tuple(b) for b in store.csr_blocks(x, 5)] == [(0, 5, [0], [0, 2], [0, 1], [1.0, 2.0]), (5, 10, [7], [0, 1], [3], [4.0])]


def test_comparisons(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 3))
    frame = lambda v: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "obs_id long, vec array<double>")
    assert abs(validation.compare_signed_columns(frame(a), frame(a * [1, -2, 3])).first()["worst"] - 1) < 1e-9
    assert abs(validation.subspace_overlap(a, a @ rng.normal(size=(3, 3))) - 1) < 1e-9
    q = np.linalg.qr(rng.normal(size=(30, 6)))[0]
    assert validation.subspace_overlap(q[:, :3], q[:, 3:]) < 1e-9
