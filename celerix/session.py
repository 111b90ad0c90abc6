"""Session helpers: shared folders and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share. Where it is unset: a temporary one in local mode, and on a cluster one in the warehouse."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="celerix-ck-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        return f"file://{_own[app]}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/celerix-{app}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; its file system deletes what is there when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends, and a lost executor loses nothing."""
    path = fresh(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once an application, wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="celerix-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "celerix_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
