"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all training texts into (language, bucket) sums; the smoothed log-probabilities of the buckets
that occur are broadcast. Texts are scored in numpy batches, as sparse rows of counts against a matrix of at most ``BUCKETS`` x
``MAX_LANGS`` doubles at a time; more languages are scored block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

BITS = 15
#: Buckets of hashed n-grams. With MAX_LANGS, the languages of a block, this bounds the matrix of a block (64 MB).
BUCKETS = 1 << BITS
MAX_LANGS = 256
ORDERS = (2, 3)
UNKNOWN = "und"
#: How far below its language's mean a text's mean log-probability may lie. By Chebyshev's inequality fewer than 1 in 36 of the
#: texts that give the mean lie 6 deviations off, whatever their distribution.
DEVIATIONS, MARGIN = 6.0, 1.0
_CHUNK = 1 << 20


def _codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, a blank before and after each; the texts' bounds among them."""
    low = [" " + (t or b"").decode("utf-8", "replace").lower() + " " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[codes < 33] = 32
    return codes, np.concatenate([[0], np.cumsum(size)])


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    acc = np.full(len(codes) - order + 1, order, np.uint64)
    for j in range(order):
        acc = (acc << np.uint64(20)) ^ (acc >> np.uint64(44)) ^ codes[j : len(codes) - order + 1 + j]
    return (T.mix(acc) >> np.uint64(64 - BITS)).astype(np.int64)


def count_grams(texts: list[bytes | None]) -> np.ndarray:
    """Bucket counts over all texts together."""
    out = np.zeros(BUCKETS, np.int64)
    for lo, hi in T.chunks(texts, _CHUNK):
        codes, first = _codes(texts[lo:hi])
        for order in ORDERS:
            b = _buckets(codes, order)
            ok = np.ones(len(b), bool)
            for back in range(1, order):  # n-grams don't reach into the next text
                ok[np.maximum(first[1:-1] - back, 0)] = False
            out += np.bincount(b[ok], minlength=BUCKETS)
    return out


def log_likelihoods(texts: list[bytes | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages): sums of logp, a (BUCKETS x languages) matrix, over each text's n-grams; and the texts' numbers of
    n-grams. A text is a sparse row of bucket counts, which picks its rows of the matrix."""
    out, n = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), np.int64)
    for lo, hi in T.chunks(texts, _CHUNK):
        codes, first = _codes(texts[lo:hi])
        grams = [_buckets(codes, order) for order in ORDERS]
        for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), lo):
            mine = np.concatenate([b[a : max(a, z - order + 1)] for order, b in zip(ORDERS, grams, strict=True)])
            count = np.bincount(mine, minlength=BUCKETS)
            held = np.flatnonzero(count)
            out[i], n[i] = count[held] @ logp[held], len(mine)
    return out, n


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[tuple], np.ndarray]:
    """Languages in order, their blocks' log-probabilities (see matrix), log-priors; from all rows with a text and a language."""
    common.ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            texts, langs = T.texts_of(b), np.array(b.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                sums[lang] = sums.get(lang, 0) + count_grams(mine)
                docs[lang] = docs.get(lang, 0) + len(mine)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            at = np.append(at, -1)  # bucket -1: documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(np.append(v[at[:-1]], docs[lang]), pa.int64())], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(common.spared(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    docs = np.zeros(len(langs))
    row = np.searchsorted(np.array(langs, object), np.array(found["lang"].to_pylist(), object)) if langs else np.zeros(0, int)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    docs[row[bucket < 0]] = n[bucket < 0]
    row, bucket, n = row[bucket >= 0], bucket[bucket >= 0], n[bucket >= 0]
    total = np.bincount(row, n, len(langs)) + 0.5 * BUCKETS
    value, rest = np.log((n + 0.5) / total[row]), np.log(0.5 / total)
    blocks = []
    for lo in range(0, len(langs), MAX_LANGS):
        mine = (row >= lo) & (row < lo + MAX_LANGS)
        blocks.append((rest[lo : lo + MAX_LANGS], (row[mine] - lo).astype(np.int16), bucket[mine], value[mine]))
    return langs, blocks, np.log(docs / max(docs.sum(), 1.0)) if langs else docs


def matrix(block: tuple) -> np.ndarray:
    """(BUCKETS x languages) of a block: the log-probabilities of buckets that don't occur, and row, bucket, value of the others."""
    rest, row, bucket, value = block
    out = np.tile(rest, (BUCKETS, 1))
    out[bucket, row] = value
    return out


def best_of(texts: list[bytes | None], blocks, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The likeliest language's place of each text, its log-likelihood with the prior, the logarithm of the sum over all
    languages, and the text's number of n-grams."""
    top, best, total = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
    lo = 0
    for logp in blocks:
        ll, n = log_likelihoods(texts, logp)
        ll += prior[lo : lo + logp.shape[1]]
        most = ll.max(1)
        top = np.where(most > best, ll.argmax(1) + lo, top)
        best = np.maximum(best, most)
        total = np.logaddexp(total, most + np.log(np.exp(ll - most[:, None]).sum(1)))
        lo += logp.shape[1]
    return top, best, total, n


def _has_letter(t: bytes | None) -> bool:
    return t is not None and any(c.isalpha() for c in t.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: tuple, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_fit: bool = False) -> DataFrame:
    """keep, then lang_pred and score, the posterior probability of lang_pred; ties go to the first language by name. with_fit
    adds fit, the mean log-probability of the text's n-grams in lang_pred, null where that is ``und``.

    Null text, or a text without letters: ``und`` with score 0. Without any learned language every text is ``und``.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"] + ["fit double"] * with_fit)

    def run(batches):
        langs, blocks, prior = shared.value
        only = [matrix(b) for b in blocks] if len(blocks) == 1 else None
        for b in batches:
            texts = T.texts_of(b, "__text")
            ok = np.array([_has_letter(t) for t in texts], bool) if langs else np.zeros(len(texts), bool)
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            fit = np.zeros(len(texts))
            if ok.any():
                mine = [texts[i] for i in np.flatnonzero(ok)]
                top, best, total, n = best_of(mine, only or map(matrix, blocks), prior)
                names[ok] = np.array(langs, object)[top]
                score[ok] = np.exp(best - total)
                if with_fit:
                    fit[ok] = (best - prior[top]) / n
            more = [pa.array(fit, mask=~ok)] * with_fit
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(names, pa.string()), pa.array(score), *more], names=[*keep, "lang_pred", "score", *["fit"] * with_fit])

    return picked.mapInArrow(common.spared(run), schema)


def least_fit(labelled: DataFrame, model: tuple, text_col: str = "text") -> F.Column:
    """The least fit of a text in its lang_pred: DEVIATIONS standard deviations, MARGIN at least, below the mean of labelled's
    texts that are found in that language; of all of them, if none is."""
    found = predict(labelled, model, keep=(), text_col=text_col, with_fit=True).filter("fit is not null")
    rows = found.groupBy("lang_pred").agg(F.count("fit").alias("n"), F.avg("fit").alias("m"), F.var_pop("fit").alias("v")).collect()
    if not rows:
        return F.lit(float("-inf"))
    n, m, v = (np.array([r[c] for r in rows], float) for c in ("n", "m", "v"))
    mean = n @ m / n.sum()
    bound = lambda m, v: float(m - max(DEVIATIONS * v**0.5, MARGIN))
    out = F.lit(bound(mean, n @ (v + (m - mean) ** 2) / n.sum()))
    return F.coalesce(F.create_map(*[F.lit(x) for r in rows for x in (r.lang_pred, bound(r.m, r.v))])[F.col("lang_pred")], out)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> F.Column:
    """Whether crc32 of the id as text falls in the part that training leaves out; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Learns from rows that aren't held out and have a language.

    Null id: not held out. Null language: not learned from, still predicted. An empty table gives an empty result.
    """
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict(named, model, keep=("doc_id", "held_out"))
