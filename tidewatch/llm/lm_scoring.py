"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams with a uniform share. The three weights depend on the
bucket (power of two) of the context's frequency and are learned by expectation-maximisation on held-out counts: each
training document is predicted from counts of which its own are deleted.

Counts are exact and of the whole training corpus. Blocks of documents send their distinct words and bigrams with their own
counts to parts (ranges of a 64-bit hash) and get totals back; no task holds more than a part or a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks as B
from tidewatch.llm import common
from tidewatch.llm import text as T

END = np.uint64(0x5BD1E9955BD1E995)
BUCKETS, BINS = 48, 72
#: Rounds of expectation-maximisation, and the least weight of the uniform share.
ROUNDS, LEAST = 60, 1e-6
_LOG = 0.35  # width of a bin of ratios, as a logarithm


def _tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the text that each belongs to."""
    w = block.words
    h, n = w.hashes(), w.n
    out = np.full(len(h) + len(n), END, np.uint64)
    doc = np.repeat(np.arange(len(n)), n + 1)
    out[np.arange(len(h)) + w.doc_of()] = h
    return out, doc


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before it; before a text's first stands an end."""
    before = np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens
    return T.mix(before * np.uint64(0xD6E8FEB86659FD93) ^ tokens)


def requests(blocks: DataFrame, parts: int) -> DataFrame:
    """For each block and part the distinct keys with the block's training counts; words in parts 0.., bigrams after."""

    def run(batches):
        for b in batches:
            for row in B.rows_of(b):
                block = B.Block(row, lower=True)
                tokens, doc = _tokens(block)
                weight = block.flags[doc].astype(float)
                for base, keys in ((0, tokens), (parts, _pairs(tokens))):
                    u, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, weights=weight, minlength=len(u)).astype(np.uint32)
                    some, cut = B.part_bounds(u, parts)
                    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(some + base, pa.int32()),
                            "block": pa.array([block.number] * len(some), pa.int64()),
                            "keys": pa.array([B.pack_keys(u[a:z]) for a, z in spans], pa.binary()),
                            "own": pa.array([B.planes(n[a:z]) for a, z in spans], pa.binary()),
                        }
                    )

    return blocks.mapInArrow(run, "part int, block long, keys binary, own binary")


def totals(asked: DataFrame, parts: int) -> DataFrame:
    """The answers: for each (block, part) the totals in the order of its keys; block -1: the part's tokens and types."""

    def run(key, f):
        asked = [B.unpack_keys(k) for k in f["keys"]]
        own = np.concatenate([B.unplanes(c, np.uint32) for c in f["own"]]).astype(float)
        u, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(at, weights=own, minlength=len(u))
        cut = np.cumsum([0] + [len(a) for a in asked])
        total = n[at].astype(np.uint64)
        back = [B.planes(total[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        part = int(key[0])
        out = pd.DataFrame({"block": f["block"], "part": part, "total": back, "n": 0, "types": 0})
        return pd.concat([out, pd.DataFrame({"block": [-1], "part": [part], "total": [b""], "n": [int(n.sum()) if part < parts else 0], "types": [int((n > 0).sum()) if part < parts else 0]})])

    return asked.groupBy("part").applyInPandas(run, "block long, part int, total binary, n long, types long")


class _Counted:
    """A block with the corpus's counts of its tokens (c), contexts (v) and bigrams (cv), and its documents' own."""

    def __init__(self, blocks_row, answers: pd.DataFrame, own: bool):
        self.block = B.Block(blocks_row, lower=True)
        self.tokens, self.doc = _tokens(self.block)
        answers = answers.sort_values("part")
        total = np.concatenate([B.unplanes(t, np.uint64) for t in answers["total"]]).astype(float)
        u, at = np.unique(self.tokens, return_inverse=True)
        pairs = _pairs(self.tokens)
        u2, at2 = np.unique(pairs, return_inverse=True)
        self.c = total[: len(u)][at]
        self.cv = total[len(u) :][at2]
        end = total[np.searchsorted(u, END)]
        self.v = np.concatenate([[end], self.c[:-1]])
        if own:
            trained = self.block.flags[self.doc]
            salt = T.mix(self.doc.astype(np.uint64))
            of = lambda keys: np.unique(T.mix(keys ^ salt), return_inverse=True, return_counts=True)
            _, a, n = of(self.tokens)
            self.c = self.c - n[a] * trained
            first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
            # a context's own count: of the same document; a text begins after one end, its own
            before = np.concatenate([[0], n[a][:-1]])
            self.v = self.v - np.where(first, 1, before) * trained
            _, a, n = of(pairs)
            self.cv = self.cv - n[a] * trained


def bucket(v: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(frequency))."""
    return np.minimum(np.where(v > 0, np.frexp(np.maximum(v, 1))[1], 0), BUCKETS - 1)


def components(c, v, cv, n: float, types: float) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram estimates over the uniform one, 1 / (types + 1)."""
    uniform = 1.0 / (types + 1.0)
    return np.where(v > 0, cv / np.maximum(v, 1), 0.0) / uniform, c / max(n, 1.0) / uniform


def _bin(r: np.ndarray) -> np.ndarray:
    return np.where(r > 0, np.clip(np.log(np.maximum(r, 1e-300)) / _LOG + 12, 1, BINS - 1).astype(int), 0)


def histogram(counted: _Counted, n: float, types: float) -> pd.DataFrame:
    """Training tokens by bucket and ratio bins, with mean ratios: all that learning the weights needs."""
    own = counted.block.flags[counted.doc]
    b = bucket(counted.v)[own]
    r2, r1 = (x[own] for x in components(counted.c, counted.v, counted.cv, n, types))
    cell = (b * BINS + _bin(r2)) * BINS + _bin(r1)
    u, at = np.unique(cell, return_inverse=True)
    return pd.DataFrame({"cell": u, "n": np.bincount(at, minlength=len(u)), "r2": np.bincount(at, weights=r2, minlength=len(u)), "r1": np.bincount(at, weights=r1, minlength=len(u))})


def learn(cells: pd.DataFrame) -> np.ndarray:
    """(BUCKETS x 3) weights of bigram, unigram and uniform by expectation-maximisation on histogram cells."""
    weights = np.tile([0.0, 1 - LEAST, LEAST], (BUCKETS, 1))
    which = cells["cell"].to_numpy() // (BINS * BINS)
    n = cells["n"].to_numpy(float)
    ratios = np.stack([cells["r2"].to_numpy(float) / n, cells["r1"].to_numpy(float) / n, np.ones(len(n))], 1)
    for k in np.unique(which):
        mine, r = n[which == k], ratios[which == k]
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = r * w
            w = (mine[:, None] * share / share.sum(1, keepdims=True)).sum(0) / mine.sum()
        w = np.maximum(w, [0, 0, LEAST])
        weights[k] = w / w.sum()
    return weights


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(counted: _Counted, n: float, types: float, weights: np.ndarray) -> pd.DataFrame:
    block, doc = counted.block, counted.doc
    size = len(block.ids)
    r2, r1 = components(counted.c, counted.v, counted.cv, n, types)
    w = weights[bucket(counted.v)]
    p = np.log10((w[:, 0] * r2 + w[:, 1] * r1 + w[:, 2]) / (types + 1.0))
    base = np.log10((counted.c + 1) / (n + types + 1))
    return pd.DataFrame(
        {
            "doc_id": pd.array(block.ids, "Int64").copy() if block.known.all() else pd.array([int(i) if k else None for i, k in zip(block.ids, block.known, strict=True)], "Int64"),
            "held_out": ~block.flags,
            "n_tokens": np.bincount(doc, minlength=size),
            "n_known": np.bincount(doc, weights=counted.c > 0, minlength=size).astype(np.int64),
            "train_tokens": int(n),
            "base_score": np.bincount(doc, weights=base, minlength=size),
            "score": np.bincount(doc, weights=p, minlength=size),
        }
    )


def score(docs: DataFrame, *, training: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    training: which rows to learn from; by default those whose crc32 of the id as text leaves no 2 modulo 7, a null id
    among them. Null and empty texts have one token, the end. Repeated rows each count. Without training rows all scores
    are those of the uniform share. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = common.staging(spark)
    if training is None:
        training = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    blocks = B.write(docs, f"{path}/blocks", id_col=id_col, text_col=text_col, flag=training)
    parts = B.parts_of(blocks)
    answers = common.saved(totals(requests(blocks, parts), parts), f"{path}/totals")
    common.release(spark)
    n, types = answers.filter("block = -1").agg(F.sum("n"), F.sum("types")).first()
    n, types = float(n or 0), float(types or 0)
    replies = answers.filter("block >= 0").select("block", "part", "total")

    def cells(left, right):
        return histogram(_Counted(left.iloc[0], right, own=True), n, types)

    found = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(cells, "cell long, n long, r2 double, r1 double")
    table = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("r1").alias("r1")).orderBy("cell").toPandas()  # at most BUCKETS x BINS x BINS rows
    weights = learn(table)
    common.release(spark)

    def scored(left, right):
        return _score(_Counted(left.iloc[0], right, own=False), n, types, weights)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(scored, _OUT)
