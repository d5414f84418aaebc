"""A session with the settings that the engine expects, and what its parts share on the driver: shipping code to executors,
shared folders, stage tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Local place for stage tables where the session names no spark.checkpoint.dir (tests only).
LOCAL_STAGING = "/tmp/checkpoints"


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(master).appName("tidewatch")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext, whatever their own path holds."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
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
    """Delete the folders that staging() gave out inside, once what was made from them is written, or failed."""
    before = len(_OPEN)
    try:
        yield
    finally:
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
