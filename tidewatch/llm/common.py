"""What the operators share on the driver: shipping code, shared folders, stage tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local place for stage tables where the session names no spark.checkpoint.dir (tests only).
LOCAL_STAGING = "/tmp/checkpoints"
#: Files whose names (some 100 bytes each) are broadcast to number their rows.
MOST_FILES = 10_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext, whatever their own path holds."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(), f"tidewatch_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.join("tidewatch", os.path.relpath(os.path.join(d, n), top)))
    sc.addPyFile(out)
    sc._tidewatch_shipped = True


_OPEN: list[str] = []


def staging(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; gone when the driver ends, or scratch()."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs(LOCAL_STAGING, exist_ok=True)
        base = f"file://{LOCAL_STAGING}"
    if not _OPEN:
        atexit.register(_at_exit, spark)
    _OPEN.append(f"{base}/tidewatch-{uuid.uuid4().hex}")
    return _OPEN[-1]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stage table; a later read of it fails, so only when nothing reads it again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the folders that staging() gave out inside, once what was made from them is written."""
    before = len(_OPEN)
    yield
    while len(_OPEN) > before:
        drop(spark, _OPEN.pop())


def _at_exit(spark: SparkSession) -> None:
    for path in _OPEN:
        try:
            drop(spark, path)
        except (AttributeError, OSError, Py4JError):  # the session has ended; the cluster's own cleaning has the rest
            return


def saved(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask Spark's cleaner to delete shuffle files of stages whose results are now in stage tables. No result depends on it:
    without it the files stay until the driver's JVM collects its garbage of its own accord."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what this process has freed but keeps: a Python worker does one task after another, and what the
    largest of them freed would count against its executor ever after. No result depends on it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def spared(work: Callable) -> Callable:
    """work, a function of batches, whose worker gives memory back when a task is done."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def spared_group(work: Callable) -> Callable:
    """The same for a function of a key and its rows, or of two groups of rows, after each."""

    def run(left, right):
        try:
            return work(left, right)
        finally:
            give_back()

    return run


def row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long of its own for each row, the same whenever the DataFrame is evaluated.

    Rows of up to MOST_FILES files are known by file and place, whatever the number of executors. Other rows get numbers in
    a stage table, since numbers by partition could change when a lost executor's work is done again.
    """
    spark = docs.sparkSession
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(name))
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().limit(MOST_FILES + 1).collect())
    except AnalysisException:  # not a scan of files
        files = []
    if not 0 < len(files) <= MOST_FILES:
        return saved(docs.withColumn(name, F.monotonically_increasing_id()), f"{staging(spark)}/rows")
    numbers = spark.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"{name}_file string, {name}_first long")
    return at.join(F.broadcast(numbers), f"{name}_file").withColumn(name, F.col(f"{name}_first") + F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns], name)
