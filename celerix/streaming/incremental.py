"""Quality control over a stream of entries: sums are commutative, so batches add to a keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.session import fresh


def entries(stream: DataFrame) -> DataFrame:
    """Running (obs_id, var_id, value) of a stream of events; state is one row for each pair seen."""
    return stream.groupBy(F.col("user_id").alias("obs_id"), F.col("event_type").alias("var_id")).agg(F.count("*").cast("double").alias("value"))


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts by event type and window; what is later than `late` is dropped, and closed windows leave the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def qc_of_stream(spark: SparkSession, path: str) -> DataFrame:
    """obs_id, total_counts, n_genes_by_counts after the files at `path` have streamed through to the end."""
    folder = fresh(spark, "stream")
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = spark.readStream.schema(schema).parquet(path)
    else:  # a stream reads folders: the file's own, and of it that file
        folder_of, name = path.rsplit("/", 1)
        stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder_of)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    run = entries(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark.read.parquet(f"{folder}/state")
    last = state.agg(F.max("batch")).first()[0]
    x = state.filter(F.col("batch") == last)
    return x.groupBy("obs_id").agg(F.sum("value").alias("total_counts"), F.count("*").alias("n_genes_by_counts"))
