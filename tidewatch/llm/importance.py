"""Importance resampling: draw documents whose words are distributed like those of a target.

Features (runs of words) fall into hashed buckets. One pass writes each block's buckets as a packed stream of unsigned
16-bit numbers with the documents' offsets. Counts come from sorting and run-length encoding the streams, block by block;
weights from a second read of them, gathering each bucket's gain and adding up between offsets. Documents then get a fixed
Gumbel noise, and the highest are drawn: a sample without replacement in proportion to exp(weight / 1000).

Only counts by bucket (65,536 at most) reach the driver. The order of all documents is a distributed sort: ranges of scores
numbered within each partition, plus the partitions' sizes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

#: Bytes between words: all of ASCII but digits and small letters (capitals are small by then).
BETWEEN = np.ones(256, bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False
#: Words over so many bytes go through the library's crc32 one by one.
LONG = 64
#: Rows of a partition of the final sort, about.
SORTED = 4_000_000
STREAMS = "block long, ids binary, known binary, rows binary, words binary, sizes binary, stream binary"


def _crc_table() -> np.ndarray:
    """CRC-32 (reflected polynomial 0xEDB88320) of each byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_TABLE = _crc_table()


def crc32s(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each byte span; before: checksums that the spans carry on."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    size = ends - starts
    for i in np.flatnonzero(size > LONG).tolist():
        crc[i] = zlib.crc32(buf[starts[i] : ends[i]], int(crc[i]))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    state = ~crc[live]
    for j in range(LONG):
        if not len(live):
            break
        state = _TABLE[(state ^ buf[starts[live] + j]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        more = size[live] > j + 1
        crc[live[~more]] = ~state[~more]
        live, state = live[more], state[more]
    return crc


def features(texts: list[bytes | None], buckets: int = 10_000, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets (uint16) of all runs of 1 to longest words joined by a space, text by text, how many each text has, and
    how many words."""
    w = T.words(texts, True, BETWEEN)
    crc = crc32s(w.buf, w.starts, w.ends)
    doc = w.doc_of()
    found, of, first = [crc], [doc], np.arange(len(crc))
    for k in range(1, longest):
        go = first + k < len(doc)
        go[go] = doc[first[go]] == doc[first[go] + k]
        first, crc = first[go], crc[go]
        crc = (_TABLE[(~crc ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~crc >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
        crc = crc32s(w.buf, w.starts[first + k], w.ends[first + k], crc)
        found.append(crc)
        of.append(doc[first])
    every, of = np.concatenate(found), np.concatenate(of)
    stream = (every % np.uint32(buckets)).astype(np.uint16)
    return stream[np.argsort(of, kind="stable")] if longest > 1 else stream, np.bincount(of, minlength=len(texts)), w.n


def streams(docs: DataFrame, buckets: int, longest: int, *, id_col: str | None, text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each few MB of text: ids (and which are known), row numbers, features a document, packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are written as 16-bit numbers: 1 to 65536 of them")
    common.ship(docs.sparkSession)
    long = lambda c: (F.lit(None) if c is None else F.col(f"`{c}`")).cast("long")
    named = docs.select(long(id_col).alias("id"), F.col(f"`{text_col}`").alias("text"), long(row_col).alias("row"))

    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for b in batches:
            ids, texts, rows = b.column(0), T.texts_of(b), b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in T.chunks(texts):
                stream, n, words = features(texts[lo:hi], buckets, longest)
                some = ids.slice(lo, hi - lo)
                made = {"block": [number], "ids": [some.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], "known": [some.is_valid().to_numpy(zero_copy_only=False).tobytes()]}
                made |= {"rows": [rows[lo:hi].astype(np.int64).tobytes()], "words": [words.astype(np.int64).tobytes()], "sizes": [n.astype(np.int64).tobytes()], "stream": [stream.tobytes()]}
                yield pa.RecordBatch.from_pydict(made)
                number += 1

    return named.mapInArrow(run, STREAMS)


def counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in the streams: sorted and run-length encoded block by block, added up for each task, then
    over tasks. At most one row a bucket comes back."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0):
                ordered = np.sort(np.frombuffer(packed.as_py(), np.uint16))
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[first]] += np.diff(np.append(first, len(ordered)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in rows.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, smoothed by one, rounded down."""
    s, t, size = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values; of an empty run 0."""
    out = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, row, n_words, n_features, weight, and the document's place: block and nth."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["sizes"], np.int64)
                known = np.frombuffer(r["known"], np.uint8).astype(bool)
                ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=~known)
                made = {"doc_id": ids, "row": pa.array(np.frombuffer(r["rows"], np.int64)), "n_words": pa.array(np.frombuffer(r["words"], np.int64)), "n_features": pa.array(n), "weight": pa.array(sums(gain[np.frombuffer(r["stream"], np.uint16)], n))}
                yield pa.RecordBatch.from_pydict(made | {"block": pa.array([r["block"]] * len(n), pa.int64()), "nth": pa.array(np.arange(len(n)))})

    return rows.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long, block long, nth long")


def noise(id_col: str, seed: int):
    """Thousandths of a standard Gumbel variable fixed by seed and id (a null id counts as empty), rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def numbered(rows: DataFrame, path: str, *order) -> DataFrame:
    """rows with position, from 1, in an order that leaves no ties: a distributed sort by ranges."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = rows.columns

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(np.arange(at, at + b.num_rows))], names=[*names, "part", "inside"])
            at += b.num_rows

    kept = common.saved(dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part long, inside long"), path)
    parts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row a partition of the sort
    parts = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return kept.join(F.broadcast(parts), "part").withColumn("position", F.col("base") + F.col("inside") + 1).drop("part", "inside", "base")


def score(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 1, percent: int = 10, least: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (from 1 for the drawn, else null), and row with row_col.

    Rows with at least least words may be drawn, percent of them (rounded down): the highest scores, ties to the smaller
    doc_id (null first), then to the earlier place in the table. Null and empty texts have no feature and weight 0. Repeated
    rows each count and are drawn each for itself, in one order. An empty target, like an empty table, counts 0 in all
    buckets. Columns beside id and text are left alone, whatever their names.
    """
    spark = docs.sparkSession
    path = common.staging(spark)
    source = common.saved(streams(docs, buckets, longest, id_col=id_col, text_col=text_col, row_col=row_col), f"{path}/streams")
    gain = gains(counts(source, buckets), counts(streams(target, buckets, longest, id_col=None, text_col=target_col), buckets))
    weighed = common.saved(weigh(source, gain), f"{path}/weights")
    scored = weighed.withColumns({"score": F.col("weight") + noise("doc_id", seed), "open": F.col("n_words") >= least})
    most = percent * scored.filter("open").count() // 100
    order = (F.desc("open"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("block"), F.asc("nth"))
    placed = numbered(scored, f"{path}/sorted", *order)
    keep = ["doc_id", "n_features", "weight", "score", F.when(F.col("open") & (F.col("position") <= most), F.col("position")).alias("rank")]
    return placed.select(*keep, *([] if row_col is None else ["row"]))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs, with all their columns; settings as in score()."""
    name = "row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    rows = common.row_key(docs, name)
    drawn = score(rows, target, row_col=name, **settings).filter("rank is not null")
    return rows.join(drawn.select(F.col("row").alias(name)), name, "left_semi").drop(name)
