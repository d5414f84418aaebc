"""Documents as blocks: rows of a few MB of compressed texts, written once to the shared folder.

Several operators look at whole texts more than once and exchange facts about a block's words with the rest of the corpus.
A block is the unit that asks: it sends its sorted distinct keys, cut by key range into parts, and gets one answer a key
back in the same order. Only keys and answers move, in planes of bytes that compress well, never a row for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

SCHEMA = "block long, raw long, ids binary, known binary, rows binary, flags binary, sizes binary, payload binary"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 6 << 20
#: Bytes of text for each part that keys are dealt over.
PART = 16 << 20


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", flag: F.Column | None = None, row_col: str | None = None, limit: int = BLOCK) -> DataFrame:
    """The blocks table. flag: a boolean column to carry, false for null; row_col: a long without nulls to carry; limit: bytes
    of text in a block."""
    common.ship(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"), F.col(f"`{text_col}`").alias("text"), (F.lit(0) if row_col is None else F.col(f"`{row_col}`")).cast("long").alias("row"))

    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        ids: list = []
        flags: list = []
        keys: list = []
        texts: list = []
        size = 0

        def made():
            raw = b"".join(texts)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "raw": pa.array([len(raw)], pa.int64()),
                    "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()],
                    "known": [np.array([i is not None for i in ids], np.uint8).tobytes()],
                    "rows": [np.array(keys, np.int64).tobytes()],
                    "flags": [np.array(flags, np.uint8).tobytes()],
                    "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()],
                    "payload": [pa.compress(raw, codec="zstd", asbytes=True)],
                }
            )

        for b in batches:
            for i, f, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), T.texts_of(b), b.column(3).to_pylist(), strict=True):
                ids.append(i)
                flags.append(f)
                keys.append(k)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= limit:
                    yield made()
                    number += 1
                    ids, flags, keys, texts, size = [], [], [], [], 0
        if texts:
            yield made()

    return common.saved(named.mapInArrow(common.spared(run), SCHEMA), path)


class Block:
    """A row of the table, unpacked. known: ids that aren't null."""

    def __init__(self, row, lower: bool = False):
        self.number = int(row["block"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.flags = np.frombuffer(row["flags"], np.uint8).astype(bool)
        size = np.frombuffer(row["sizes"], np.int64)
        raw = pa.decompress(row["payload"], int(row["raw"]), codec="zstd", asbytes=True) if row["raw"] else b""
        end = np.cumsum(size)
        self.texts = [raw[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]
        self.words = T.words(self.texts, lower)


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time."""
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def parts_of(blocks: DataFrame) -> int:
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return max(4, -(-raw // PART))


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, all first bytes first: leading zeros of small numbers then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def part_bounds(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted uint64 keys fall in, and where each one's keys begin (and the last one's end); parts are equal
    ranges of keys. Work in proportion to the keys, however many parts there are."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return part[first].astype(np.int64), np.append(first, len(keys))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)
