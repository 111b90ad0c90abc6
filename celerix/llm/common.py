"""Shared folders, materialised intermediates and text helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of our own where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="celerix-")
        atexit.register(shutil.rmtree, _own_root[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + _own_root[app])
    return "file://" + _own_root[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is there when the driver's Python ends goes, if this machine can reach it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    if _open is not None:
        _open.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a stored DataFrame that no later result reads."""
    _delete(spark, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: list[str] | None = None  # folders stored in the scratch scope that is open
_closed: list[str] = []  # and in those that were


@contextlib.contextmanager
def scratch(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """A stage of a pipeline whose results are written before the next stage is called: what earlier stages stored on
    their way is deleted now, but for files that docs reads."""
    global _open
    needed = {f.rsplit("/", 1)[0].split("/")[-1] for f in docs.inputFiles()}
    _delete(spark, [p for p in _closed if p.rsplit("/", 1)[1] not in needed])
    _closed[:] = [p for p in _closed if p.rsplit("/", 1)[1] in needed]
    _open = []
    try:
        yield
    finally:
        _closed.extend(_open)
        _open = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def text_id(text: Column | None = None) -> Column:
    """A 64-bit hash of the text column: rows that share a doc_id, or have none, are told apart by it."""
    return F.xxhash64((F.col("text") if text is None else text).cast("string"))


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_BYTES at most, or one row: workers hold a batch at a time, whatever rows weigh."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_left: dict[str, dict] = {}  # by operator: what its tasks leave to its next ones in the same worker


def left(operator: str) -> dict:
    """A dict of this process that lasts from task to task of one operator, until a lean() task of another one begins."""
    return _left.setdefault(operator, {})


def forget(operator: str | None) -> None:
    """Drop what the tasks of other operators left."""
    for name, kept in _left.items():
        if name != operator:
            kept.clear()


def hand_back() -> None:
    """Give the system what was freed: Arrow's pool and the C library keep it for later, and numpy's arrays come from the latter."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], operator: str | None = None) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, that leaves no memory behind. Python workers serve one stage after the other, so
    what they keep counts beside each later stage: first what other operators left is dropped, and at the end what the task
    itself freed goes back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(operator)
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in `column` total at most `limit` bytes (a longer text stands alone)."""
    lengths = batch.column(column).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8)) if len(lengths) else np.zeros(0, int)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last; call trim() between batches to bound memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
