"""Quality rules: base counts of a text, and robust multivariate outliers among them per language and source.

Base counts come from one vectorised pass over whole texts. The vectors (mean word length, symbol share, duplicate-line
share, repeated-word share; each transformed, see ``VECTOR``) are judged against minimum-covariance-determinant estimates
of their (language, source) group: two deterministic starts, concentration steps over all rows of all groups at once, the
start with the smaller determinant wins. The same is done for each language and for all rows, and a group's estimate is
shrunk towards its language's, and that one towards the whole's, the more so the fewer rows it has. Every step is one
partially aggregated sum per group, so that a group holding a third of all rows is never gathered in one task; estimates
travel as one small row for each group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
VECTOR = ("v_length", "v_symbols", "v_dup", "v_repeat")
#: Standard deviations below which a component isn't taken to be known, in units of the transformed component: constant
#: columns (no symbols, no repeated lines) would make a covariance singular and any deviation an outlier.
FLOORS = (0.06, 0.05, 0.08, 0.08)
#: Rows that the next wider group's estimate counts for when a group's is shrunk towards it.
SHRINK = 40
STEPS = 6
#: Chance that a clean document, if its vector were Gaussian, is rejected.
REJECT = 1e-6
#: Groups up to which their estimates (300 bytes each) are broadcast; beyond, rows and estimates meet by group and salt.
FEW_GROUPS, SALTS = 10_000, 256
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_stats(rows: list[bytes | None]) -> dict[str, np.ndarray]:
    """The base counts of each text. Null and empty texts count 0 throughout."""
    w = T.words(rows)
    n = len(rows)
    h = w.hashes()
    doc = w.doc_of()
    chars = w.per_text(~T.SPACE[w.buf] & ((w.buf & 0xC0) != 0x80))
    symbols = w.per_text(_SYMBOL[w.buf])
    # words covered by a 3-word window that the text has twice or more
    covered = np.zeros(len(h) + 3, np.int64)
    g = T.grams(h, 3)
    at = np.flatnonzero(T.inside(w.first, 3, len(g)))
    key = T.mix(g[at] ^ T.mix(doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    np.add.at(covered, at[twice], 1)
    np.subtract.at(covered, at[twice] + 3, 1)
    repeat = np.bincount(doc[np.cumsum(covered)[: len(h)] > 0], minlength=n)
    # lines with a word
    ends = np.flatnonzero(w.buf == 10)[1:]
    ends = ends[ends <= (w.at[-1] + w.size[-1] if n else 0)]
    starts = np.concatenate([[1], ends[:-1] + 1]) if len(ends) else ends
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(w.at, starts, side="right") - 1
    key = T.mix(T.hash_spans(w.buf, starts, ends) ^ T.mix(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return {
        "n_words": w.n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_lines": np.bincount(owner, minlength=n),
        "n_dup_lines": np.bincount(owner[again], minlength=n),
        "n_repeat_words": repeat,
    }


def base_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, then the base counts, one row per input row."""
    common.ship(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [STATS])

    def run(batches):
        for b in batches:
            rows = T.texts_of(b, "__text")
            for lo, hi in T.chunks(rows):
                s = count_stats(rows[lo:hi])
                kept = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(s[c], pa.int64()) for c in STAT_NAMES], names=[*keep, *STAT_NAMES])

    return picked.mapInArrow(common.spared(run), schema)


def with_vector(stats: DataFrame) -> DataFrame:
    words = F.col("n_words") + F.lit(1.0)
    return stats.withColumns(
        {
            "v_length": F.log((F.col("word_chars") + F.lit(1.0)) / words),
            "v_symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + F.lit(1.0))),
            "v_dup": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(4.0))),
            # a long text repeats more of its 3-word windows by chance: the share is taken against the root of its length
            "v_repeat": F.sqrt(F.col("n_repeat_words") / words) / F.log10(F.col("n_words") + F.lit(10.0)) * F.lit(2.0),
        }
    )


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    if x > a + 200:
        return 1.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(d / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def _distance(names=VECTOR) -> F.Column:
    """Squared Mahalanobis distance of the vector to (mu, prec) on the same row."""
    d = len(names)
    diff = [F.col(n) - F.col("mu")[i] for i, n in enumerate(names)]
    out = F.lit(0.0)
    for i in range(d):
        out = out + diff[i] * diff[i] * F.col("prec")[i * d + i]
        for j in range(i):
            out = out + F.lit(2.0) * diff[i] * diff[j] * F.col("prec")[i * d + j]
    return out


_PARAMS = "grp string, start int, mu array<double>, prec array<double>, logdet double"
_ALL = "a"


def _estimates(names=VECTOR, floors=FLOORS):
    """Turns rows of sums (n, s_i, s_i_j) into means, precisions and log-determinants, many groups at a time."""
    d = len(names)

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            n = f["n"].to_numpy(float)[:, None]
            mu = np.stack([f[f"s_{i}"].to_numpy(float) for i in range(d)], 1) / n
            cov = np.zeros((len(f), d, d))
            for i in range(d):
                for j in range(i + 1):
                    cov[:, i, j] = cov[:, j, i] = f[f"s_{i}_{j}"].to_numpy(float) / n[:, 0] - mu[:, i] * mu[:, j]
            cov += np.diag(np.square(floors))
            yield pd.DataFrame(
                {
                    "grp": f["grp"],
                    "start": f["start"],
                    "mu": list(mu),
                    "prec": list(np.linalg.inv(cov).reshape(len(f), d * d)),
                    "logdet": np.linalg.slogdet(cov)[1],
                }
            )

    return run


def _sums(rows: DataFrame, names=VECTOR) -> DataFrame:
    d = len(names)
    cols = [F.count(F.lit(1)).alias("n")] + [F.sum(n).alias(f"s_{i}") for i, n in enumerate(names)]
    cols += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in range(d) for j in range(i + 1)]
    return rows.groupBy("grp", "start").agg(*cols)


def _attach(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join rows, which have a salt column, with one row a group; a group of any size is spread over tasks."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    return rows.join(groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), [*on, "salt"], how)


def mcd(vectors: DataFrame, path: str, few: bool, steps: int = STEPS, floors=FLOORS) -> DataFrame:
    """(grp, n, mu, prec, scale) for each group of vectors (grp, *VECTOR): the covariance determinant is the smallest found.

    h is half of the group's rows (ties at the h-th distance all count); scale makes the median distance that of a
    chi-square variable. Groups of any size are estimated from all of their rows; medians and the h-th distance are those of
    percentile_approx, exact up to its accuracy of 10,000 rows, and beyond that off by at most n / 10,000 places.
    """
    d = len(VECTOR)
    estimate = _estimates(VECTOR, floors)
    half = vectors.groupBy("grp").agg(*[F.percentile_approx(n, 0.5, 10000).alias(f"m_{i}") for i, n in enumerate(VECTOR)])
    half = common.saved(half, f"{path}/median")
    centred = _attach(vectors, half, ["grp"], few)
    spread = centred.groupBy("grp").agg(
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{i}")), 0.5, 10000).alias(f"d_{i}") for i, n in enumerate(VECTOR)]
    )
    # start 0: medians and median absolute deviations; start 1: covariance of the directions from the median
    mad = half.join(spread, "grp")
    sd = [F.col(f"d_{i}") * F.lit(1.4826) for i in range(d)]
    zero = mad.select(
        "grp",
        F.lit(0).alias("start"),
        F.array(*[F.col(f"m_{i}") for i in range(d)]).alias("mu"),
        F.array(*[F.lit(1.0) / (sd[i] * sd[i] + F.lit(floors[i] ** 2)) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("prec"),
        F.lit(0.0).alias("logdet"),
    )
    far = [(F.col(n) - F.col(f"m_{i}")) / F.lit(floors[i]) for i, n in enumerate(VECTOR)]
    size = F.sqrt(sum((x * x for x in far[1:]), far[0] * far[0]) + F.lit(1e-12))
    signs = centred.select("grp", F.lit(1).alias("start"), *[(x / size * F.lit(floors[i]) + F.col(f"m_{i}")).alias(VECTOR[i]) for i, x in enumerate(far)])
    one = _sums(signs).mapInPandas(estimate, _PARAMS)
    params = common.saved(zero.unionByName(one), f"{path}/step0")
    for k in range(1, steps + 1):
        near = _attach(vectors, params, ["grp"], few).withColumn("dist", _distance())
        edge = near.groupBy("grp", "start").agg(F.percentile_approx("dist", 0.5, 10000).alias("edge"))
        subset = _attach(near, edge, ["grp", "start"], few).filter(F.col("dist") <= F.col("edge"))
        params = common.saved(_sums(subset).mapInPandas(estimate, _PARAMS), f"{path}/step{k}")
    best = params.groupBy("grp").agg(F.min_by(F.struct("mu", "prec"), F.struct("logdet", "start")).alias("b")).select("grp", "b.mu", "b.prec")
    middle = _attach(vectors, best, ["grp"], few).withColumn("dist", _distance()).groupBy("grp").agg(F.percentile_approx("dist", 0.5, 10000).alias("middle"), F.count(F.lit(1)).alias("n"))
    scale = F.greatest(F.lit(1.0), F.col("middle") / F.lit(chi2_quantile(0.5, d)))
    return common.saved(best.join(middle, "grp").select("grp", "n", "mu", "prec", scale.alias("scale")), f"{path}/best")


def blend(mu1, cov1, mu2, cov2, w):
    """Mean and covariance of a mixture, w of the first and 1 - w of the second; arrays over groups."""
    w, d = w[:, None], mu1 - mu2
    return w * mu1 + (1 - w) * mu2, w[..., None] * cov1 + (1 - w[..., None]) * cov2 + (w * (1 - w))[..., None] * d[:, :, None] * d[:, None, :]


def _shrunk(best: DataFrame, groups: DataFrame, shrink: float) -> DataFrame:
    """(own, mu, prec) of groups (own, pool) from the estimates of their own, their languages' and all rows."""
    d = len(VECTOR)
    whole = best.filter(F.col("grp") == _ALL).first()
    if whole is None:
        return groups.sparkSession.createDataFrame([], "own string, mu array<double>, prec array<double>")

    def moments(mu, prec, scale):
        prec = np.stack(prec).reshape(-1, d, d)
        return np.stack(mu), np.linalg.inv(prec) * np.asarray(scale, float)[:, None, None]

    top = moments([whole["mu"]], [whole["prec"]], [whole["scale"]])

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            share = lambda n: n.to_numpy(float) / (n.to_numpy(float) + shrink)
            pool = blend(*moments(f["mu2"], f["prec2"], f["scale2"]), *top, share(f["n2"]))
            mu, cov = blend(*moments(f["mu"], f["prec"], f["scale"]), *pool, share(f["n"]))
            yield pd.DataFrame({"own": f["own"], "mu": list(mu), "prec": list(np.linalg.inv(cov).reshape(-1, d * d))})

    wider = best.select(F.col("grp").alias("pool"), *[F.col(c).alias(f"{c}2") for c in ("n", "mu", "prec", "scale")])
    return groups.join(best.withColumnRenamed("grp", "own"), "own").join(wider, "pool").mapInPandas(run, "own string, mu array<double>, prec array<double>")


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    reject: float = REJECT,
    shrink: float = SHRINK,
    steps: int = STEPS,
) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, distance and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. Other documents are rejected if
    their squared distance to the group's shrunk estimate passes the chi-square quantile 1 - reject. Null text: no words, so
    base_failed. Null language or source: a group of its own. A group of any size, one row too, has an estimate. Repeated
    rows are rows like any others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = common.staging(spark)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    stats = common.saved(with_vector(base_stats(named)), f"{path}/stats")
    key = F.concat_ws("\x01", F.lit("g"), F.coalesce(F.col("lang"), F.lit("\x02")), F.coalesce(F.col("source"), F.lit("\x02")))
    pool = F.concat_ws("\x01", F.lit("p"), F.coalesce(F.col("lang"), F.lit("\x02")))
    stats = stats.withColumns({"own": key, "pool": pool, "salt": F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")})
    groups = common.saved(stats.select("own", "pool").distinct(), f"{path}/groups")
    few = groups.count() <= FEW_GROUPS
    best = mcd(stats.select(F.explode(F.array("own", "pool", F.lit(_ALL))).alias("grp"), "salt", *VECTOR), path, few, steps)
    final = common.saved(_shrunk(best, groups, shrink), f"{path}/shrunk")
    limit = chi2_quantile(1 - reject, len(VECTOR))
    judged = _attach(stats, final, ["own"], few).withColumn("distance", _distance())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        *[c for c in STAT_NAMES if c != "n_lines"],
        failed.alias("base_failed"),
        (~failed & (F.col("distance") <= F.lit(limit))).alias("kept"),
        "distance",
    )
