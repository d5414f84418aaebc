"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Files hold documents in ascending id order, so that a range of ids prunes files and stripes by their statistics and a
single id prunes row groups by its Bloom filter; stripes are read in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import bpe, common
from tidewatch.llm import text as T

SCHEMA = "doc_id long, row long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
}
#: Bytes of text whose ids go into one Arrow batch from a worker, and bytes of text in a file, on average at most.
_BATCH, FILE = 4 << 20, 256 << 20


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append end_id, and write ORC files whose split numbers and rows ascend by id.

    Null text: only end_id. Null ids come first. Repeated ids are ordered by text. An empty table writes no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    where = vocabulary or bpe.vocabulary()
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))
    dealt = named.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        encoder, row = bpe.encoder(where), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0), T.texts_of(b)
            for lo, hi in T.chunks(texts, _BATCH):
                flat, bound = encoder.many(texts[lo:hi], end)
                lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), lists], names=["doc_id", "row", "ids"])
                row += hi - lo

    dealt.mapInArrow(run, SCHEMA).write.mode("overwrite").options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row (its place in its file), ids; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def digests(spark: SparkSession, path: str, work: str) -> DataFrame:
    """From files of write(): doc_id, start, n_tokens and ids_crc32 of each document, in one parallel read of the stripes."""
    common.ship(spark)
    rows = read(spark, path).select("doc_id", "row", "ids", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("file"))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    slim = common.saved(rows.mapInArrow(run, "doc_id long, row long, file long, n_tokens long, ids_crc32 long"), f"{work}/digests")
    # one row a file; file is its split number, which ascends as ids do
    files = slim.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return slim.withColumn("inside", inside).join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, *, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs' ids (to path, or a stage folder), read the files back, and return their digests."""
    spark = docs.sparkSession
    work = common.staging(spark)
    write(docs, path or f"{work}/ids", vocabulary=vocabulary)
    return digests(spark, path or f"{work}/ids", work)
