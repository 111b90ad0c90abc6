"""Stores: one Parquet dataset per slot; scans are lazy and split by file, so any size takes the same path."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.frame import AnnFrame

BUDGET = 2 << 30


def auto_block_rows(n_vars: int, requested: int = 100_000, budget: int = BUDGET) -> int:
    """Rows of a dense 4-byte block that stays within the budget, at most `requested`, at least 1."""
    return max(1, min(requested, budget // (4 * max(1, n_vars))))


def write_store(frame: AnnFrame, path: str, block_rows: int = 20_000) -> None:
    """All slots below path; x is range-partitioned and sorted by obs_id, so row ranges prune files and row groups."""
    parts = max(1, -(-frame.n_obs // block_rows))
    order = lambda df: df.repartitionByRange(parts, "obs_id").sortWithinPartitions("obs_id", "var_id")
    frame.obs.write.mode("overwrite").parquet(f"{path}/obs")
    frame.var.write.mode("overwrite").parquet(f"{path}/var")
    order(frame.x).write.mode("overwrite").parquet(f"{path}/x")
    slots: dict = {"layers": sorted(frame.layers), "raw": frame.raw is not None}
    for key, df in frame.layers.items():
        order(df).write.mode("overwrite").parquet(f"{path}/layers/{key}")
    for kind in ("obsm", "varm", "obsp"):
        slots[kind] = sorted(getattr(frame, kind))
        for key, df in getattr(frame, kind).items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{key}")
    if frame.raw:
        order(frame.raw[0]).write.mode("overwrite").parquet(f"{path}/raw/x")
        frame.raw[1].write.mode("overwrite").parquet(f"{path}/raw/var")
    frame.obs.sparkSession.createDataFrame([(json.dumps(slots),)], "slots string").coalesce(1).write.mode("overwrite").text(f"{path}/slots")


def open_store(spark: SparkSession, path: str) -> AnnFrame:
    slots = json.loads(spark.read.text(f"{path}/slots").first()[0])
    read = lambda *p: spark.read.parquet("/".join([path, *p]))
    return AnnFrame(
        read("obs"), read("var"), read("x"), layers={k: read("layers", k) for k in slots["layers"]}, raw=(read("raw", "x"), read("raw", "var")) if slots["raw"] else None,
        obsm={k: read("obsm", k) for k in slots["obsm"]}, varm={k: read("varm", k) for k in slots["varm"]}, obsp={k: read("obsp", k) for k in slots["obsp"]},
    )


def materialize(frame: AnnFrame, path: str, block_rows: int = 20_000) -> AnnFrame:
    """The pending transforms of x are run and stored; the frame goes on from the stored matrix."""
    parts = max(1, -(-frame.n_obs // block_rows))
    frame.x.repartitionByRange(parts, "obs_id").sortWithinPartitions("obs_id", "var_id").write.mode("overwrite").parquet(path)
    return replace(frame, x=frame.x.sparkSession.read.parquet(path))


def write_transformed(frame: AnnFrame, path: str, block_rows: int = 20_000) -> None:
    """The frame with its transformed x as a store; a centred matrix, which is dense, is refused."""
    if frame.uns.get("scaled"):
        raise ValueError("a scaled matrix is dense; store what it was scaled from")
    write_store(frame, path, block_rows)


def iter_row_blocks(x: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """block, ids, indptr, var_ids, values: the compressed rows of each stretch of block_rows obs_ids."""
    spans = x.withColumn("block", F.floor(F.col("obs_id") / block_rows).cast("long"))

    def compress(t: pa.Table) -> pa.Table:
        t = t.sort_by([("obs_id", "ascending"), ("var_id", "ascending")])
        counts = t.group_by("obs_id", use_threads=False).aggregate([("var_id", "count")])
        ends = [0]
        for n in counts.column("var_id_count").to_pylist():
            ends.append(ends[-1] + n)
        one = lambda c: pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type))
        return pa.table({"block": t.column("block").slice(0, 1), "ids": pa.array([counts.column("obs_id").to_pylist()], pa.list_(pa.int64())), "indptr": pa.array([ends], pa.list_(pa.int64())), "var_ids": one("var_id"), "values": one("value")})

    kind = dict(x.dtypes)["var_id"]
    return spans.groupBy("block").applyInArrow(compress, f"block long, ids array<long>, indptr array<long>, var_ids array<{kind}>, values array<double>")


def csr_blocks(x: DataFrame, block_rows: int = 100_000) -> Iterator[tuple]:
    """The blocks of iter_row_blocks in order, one at a time on the driver."""
    for r in iter_row_blocks(x, block_rows).orderBy("block").toLocalIterator():
        yield r["block"] * block_rows, (r["block"] + 1) * block_rows, r["ids"], r["indptr"], r["var_ids"], r["values"]


def long_to_dense(x: DataFrame, n_vars: int) -> DataFrame:
    """obs_id, vec: rows as arrays of n_vars numbers; var_id are 0 to n_vars - 1."""
    pairs = x.groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("var_id").cast("int"), "value"))).alias("m"))
    return pairs.select("obs_id", F.transform(F.sequence(F.lit(0), F.lit(n_vars - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("vec"))


def dense_to_long(vecs: DataFrame) -> DataFrame:
    return vecs.select("obs_id", F.posexplode("vec").alias("var_id", "value")).filter("value <> 0")


def write_obsm(frame: AnnFrame, key: str, path: str) -> str:
    frame.obsm[key].write.mode("overwrite").parquet(path)
    return path


def write_report(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("header", True).csv(path)


def read_matrix_market(spark: SparkSession, source: str, transpose: bool = False) -> AnnFrame:
    """The coordinate matrix in a Matrix Market file (.mtx, .mtx.gz): rows are obs, columns var (the other way round if
    transpose), both counted from 0 and there even where they are empty; repeated entries add up."""
    lines = spark.read.text(source).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))
    top = lines.filter("at = 0 and line <> ''").orderBy("place")
    banner = top.first()
    kind = banner["line"].lower().split() if banner else []
    if kind[:3] != ["%%matrixmarket", "matrix", "coordinate"] or kind[3:4] not in (["real"], ["integer"], ["pattern"]) or kind[4:] not in (["general"], ["symmetric"], ["skew-symmetric"]):
        raise ValueError("a Matrix Market file of real, integer or pattern coordinates is needed")
    body = "line <> '' and not startswith(line, '%')"
    sizes = top.filter(body).first()
    if sizes is None:
        raise ValueError("the file names no size")
    n_obs, n_var = (int(v) for v in sizes["line"].split()[:2])
    part = F.split("line", r"\s+")
    value = F.lit(1.0) if kind[3] == "pattern" else part[2].cast("double")
    x = lines.filter(body).filter(F.col("place") != sizes["place"]).select((part[0].cast("long") - 1).alias("obs_id"), (part[1].cast("long") - 1).alias("var_id"), value.alias("value"))
    if kind[4] != "general":
        x = x.union(x.filter("obs_id <> var_id").select("var_id", "obs_id", F.col("value") * (-1 if kind[4] == "skew-symmetric" else 1)))
    if transpose:
        n_obs, n_var = n_var, n_obs
        x = x.select(F.col("var_id").alias("obs_id"), F.col("obs_id").alias("var_id"), "value")
    x = x.groupBy("obs_id", "var_id").agg(F.sum("value").alias("value")).filter("value <> 0")
    return AnnFrame(spark.range(n_obs).toDF("obs_id"), spark.range(n_var).select(F.col("id").cast("string").alias("var_id")), x.withColumn("var_id", F.col("var_id").cast("string")))


def convert(spark: SparkSession, source: str, path: str, block_rows: int = 20_000) -> AnnFrame:
    """A (obs, var, value) table in Parquet, ORC, CSV or JSON, with columns obs_id, var_id, value, or a Matrix Market file, made a store."""
    kind = source.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind == "mtx":
        write_store(read_matrix_market(spark, source), path, block_rows)
        return open_store(spark, path)
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    raw = reader.format({"csv": "csv", "json": "json", "orc": "orc"}.get(kind, "parquet")).load(source)
    x = raw.select(F.col("obs_id").cast("long"), F.col("var_id").cast("string"), F.col("value").cast("double")).groupBy("obs_id", "var_id").agg(F.sum("value").alias("value")).filter("value <> 0")
    write_store(AnnFrame(raw.select(F.col("obs_id").cast("long")).distinct(), raw.select(F.col("var_id").cast("string")).distinct(), x), path, block_rows)
    return open_store(spark, path)
