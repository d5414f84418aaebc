"""Approximate nearest neighbours: an inverted file of coarse centroids over product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. Equal vectors are one entry with a number of
its own; ids come back only at the end, since rows may share one. A query probes the nearest lists, scores their codes by tables of distances between its residual and the
codebooks (the query itself is not quantised), and each group's best candidates are ranked again by exact cosine. How many
lists and candidates that takes is measured on some of the queries themselves, against all entries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Most vectors, and most numbers, that centroids and codebooks are fitted on.
SAMPLE, SAMPLE_NUMBERS = 32_768, 1 << 23
#: Coarse centroids of the first level, codes in a codebook, components to a code.
COARSE, CODES, PER_CODE = 1024, 256, 4
#: Share of the trial queries' true neighbours that the probed lists, and then the reranked candidates, must hold; trials.
REACH, TRIALS = 0.985, 128
#: Fewest candidates ranked exactly; entries, and numbers of their vectors, in a group of lists, or of parts of a long list.
RERANK, GROUP, GROUP_NUMBERS = 100, 16_384, 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; an empty cluster takes the row that is farthest from its centre."""
    x = np.asarray(x, np.float64)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(n == 0)
        centres = sums / np.maximum(n, 1)[:, None]
        if len(empty):
            centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, each row's nearest centre."""
    best, far = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        d = squared(x[lo : lo + 4096], centres)
        best[lo : lo + 4096] = d.argmin(1)
        far[lo : lo + 4096] = d.min(1)
    return best, far


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; equal rows give equal results wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Index:
    """coarse: (lists x dim), about as many as the root of n; books: (subspaces x codes x width), over residuals of unit vectors.

    Beyond COARSE lists each first-level list is split by a second-level codebook over residuals, so that the sample stays
    bounded. probes and rerank are what trial queries needed to find REACH of their neighbours, once calibrate() has them.
    """

    def __init__(self, sample: np.ndarray, n: int, k: int = 5):
        x = unit(np.asarray(sample, np.float64))
        self.dim = x.shape[1]
        lists = max(1, round(np.sqrt(n)))
        self.first = kmeans(x, min(COARSE, len(x) // 16 or 1, lists))
        rest = x - self.first[nearest(x, self.first)[0]]
        self.second = kmeans(rest, round(lists / len(self.first))) if lists >= 2 * len(self.first) else np.zeros((1, self.dim))
        self.coarse = (self.first[:, None] + self.second).reshape(-1, self.dim)
        self.width = next(w for w in range(PER_CODE, 0, -1) if self.dim % w == 0)
        near = self.list_of(x)
        rest = (x - self.coarse[near]).reshape(len(x), -1, self.width)
        self.books = np.stack([_padded(kmeans(rest[:, j], CODES, 8, j)) for j in range(rest.shape[1])])
        #: lists in an order in which neighbours stand together, so that the lists of a query fall into few groups
        self.order = np.argsort(nearest(self.coarse, kmeans(self.coarse, round(np.sqrt(len(self.coarse)))))[0], kind="stable")
        self.probes, self.rerank = len(self.coarse), RERANK

    def list_of(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector: its first-level centroid, then that of its residual."""
        near = nearest(x, self.first)[0]
        return near * len(self.second) + nearest(x - self.first[near], self.second)[0]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        x = unit(v)
        near = self.list_of(x)
        rest = (x - self.coarse[near]).reshape(len(x), -1, self.width)
        return near, np.stack([nearest(rest[:, j], b)[0] for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(subspaces x codes) inner products of a unit query with the codebooks."""
        return (q.reshape(-1, 1, self.width) * self.books).sum(2)

    def far(self, q: np.ndarray, base: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Squared distances of a unit query to what codes (one row a subspace) stand for; base: the query's distances to the
        entries' lists and own(). Entries of one list and with equal codes are exactly as far."""
        near = np.zeros(columns.shape[1])
        for table, code in zip(self.tables(q), columns, strict=True):
            near += table[code]
        return base - 2 * near

    def own(self, which: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What each entry adds to a query's distance whatever the query: |r|^2 + 2 c r for its residual r in list c."""
        rest = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
        return (rest * rest).sum(1) + 2 * (self.coarse[which] * rest).sum(1)


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.full((CODES - len(book), book.shape[1]), 1e6)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    return rows.filter(F.exists("v", lambda x: x != 0.0))


def search(vectors: DataFrame, queries: F.Column | None = None, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, ties to the smaller id; all if there are fewer.

    queries: a condition on id; by default ids divisible by 50. Rows count, not ids: each row that meets the condition is a
    query, and every row but itself is its candidate, so that a repeated id may be found several times, also by a query of
    that id, and equal query rows each give their k. rerank: candidates ranked exactly, by default what the index needs.
    Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do null ids; vectors of each
    length are searched among themselves. rerank is by group of lists, and what is as far as the last is ranked too. Equal vectors are indexed once with their k + 1 smallest ids, no more of which
    can be among the k nearest. An empty table gives an empty result.
    """
    common.ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    widths = sorted(r["w"] for r in rows.select(F.size("v").alias("w")).distinct().collect())
    found = [_search(rows.filter(F.size("v") == w), w, queries, k, rerank) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, width: int, queries: F.Column | None, k: int, rerank: int | None) -> DataFrame:
    """search() among rows (id, v) whose vectors all have one length."""
    spark = rows.sparkSession
    path = common.staging(spark)
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    asked = F.pmod(F.col("id"), F.lit(50)) == 0 if queries is None else queries
    rows = rows.withColumn("asked", asked)
    # equal vectors: the smallest ids, cut before the shuffle too; the first of them is an entry and has the vector
    order = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    first = rows.withColumn("nth", order).filter(F.col("nth") <= k + 1)
    few = common.saved(first.select("k1", "k2", "id", "nth", F.when(F.col("nth") == 1, F.col("v")).alias("v"), F.monotonically_increasing_id().alias("entry")), f"{path}/few")
    entries = few.filter("nth = 1").select("k1", "k2", F.col("id").alias("least"), "v", "entry")
    n = entries.count()
    size = min(SAMPLE, max(1, SAMPLE_NUMBERS // width))
    sample = entries.orderBy(F.xxhash64("k1", "k2")).limit(size).select("v").toPandas()["v"]
    index = Index(np.stack(sample.to_numpy()), n, k)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        index = shared.value
        for b in batches:
            near, codes = index.encode(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["entry", "least", "v", "list", "codes"])

    codes = common.saved(entries.select("entry", "least", "v").mapInArrow(encode, "entry long, least long, v array<double>, list int, codes binary"), f"{path}/codes")
    # equal queries are searched once
    wanted = common.saved(rows.filter("asked").groupBy("k1", "k2", F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("times")), f"{path}/wanted")
    asked_entries = common.saved(entries.join(wanted.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select(F.col("entry").alias("query"), F.col("v").alias("q")), f"{path}/asked")
    calibrate(index, codes, asked_entries, k)
    probes, rerank = index.probes, rerank or index.rerank
    # lists are put together, or a long one dealt out, to groups of about most entries
    sizes = {r["list"]: r["count"] for r in codes.groupBy("list").count().collect()}  # about the root of n rows
    most = min(GROUP, max(1, GROUP_NUMBERS // width))
    groups, used, room = {}, 0, 0
    for c in index.order.tolist():
        if c not in sizes:
            continue
        if sizes[c] > room:
            used, room = used + 1, most
        groups[c] = (used, -(-sizes[c] // most))
        used, room = used + groups[c][1] - 1, room - sizes[c]
    held = spark.sparkContext.broadcast((sizes, groups))

    def probe(batches):
        """For each query and group the lists to look at: the nearest, and further ones until rerank entries are in reach."""
        index, (sizes, groups) = shared.value, held.value
        full = np.array(sorted(sizes))
        count = np.array([sizes[c] for c in full])
        for b in batches:
            row, which, lists = [], [], []
            for i, o in enumerate(squared(unit(_matrix(b.column(1))), index.coarse[full]).argsort(1, kind="stable")):
                m = max(probes, int(np.searchsorted(np.cumsum(count[o]), rerank)) + 1)
                per: dict[int, list[int]] = {}
                for c in full[o[:m]].tolist():
                    for g in range(groups[c][0], groups[c][0] + groups[c][1]):
                        per.setdefault(g, []).append(c)
                row += [i] * len(per)
                which += per.keys()
                lists += per.values()
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(which, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query", "q", "group", "lists"])

    probed = asked_entries.mapInArrow(probe, "query long, q array<double>, group int, lists array<int>")
    deal = spark.createDataFrame([(c, *g) for c, g in groups.items()], "list int, first int, parts int")
    dealt = codes.join(F.broadcast(deal), "list").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("entry"), F.col("parts"))).cast("int")).select("group", "list", "entry", "least", "v", "codes")

    def scan(key, q, c):
        index = shared.value
        found = [pd.DataFrame({"query": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(q) and len(c):
            entry, least, which, v = c["entry"].to_numpy(), c["least"].to_numpy(), c["list"].to_numpy(), np.stack(c["v"].to_numpy())
            code = _codes(c["codes"])
            own, columns = index.own(which, code), np.ascontiguousarray(code.T)
            for name, vector, lists in zip(q["query"].to_numpy(), np.stack(q["q"].to_numpy()), q["lists"], strict=True):
                unit_vector = vector / np.sqrt((vector * vector).sum())
                near = np.full(len(index.coarse), np.inf)
                near[lists] = ((unit_vector - index.coarse[lists]) ** 2).sum(1)
                far = index.far(unit_vector, near[which] + own, columns)
                best = np.flatnonzero(np.isfinite(far) & (entry != name))
                if len(best) > rerank:  # and all that are as far as the last
                    best = best[far[best] <= np.partition(far[best], rerank - 1)[rerank - 1]]
                score = cosine(np.broadcast_to(vector, (len(best), len(vector))), v[best])
                top = np.lexsort([entry[best], least[best], -score])[:k]
                found.append(pd.DataFrame({"query": name, "entry": entry[best][top], "score": score[top]}))
        return pd.concat(found)

    def itself(batches):
        for b in batches:
            q = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array(cosine(q, q) if b.num_rows else [], pa.float64())], names=["query", "entry", "score"])

    # a query's own entry may have further rows, so it is a candidate wherever its code stands
    ranked = probed.groupBy("group").cogroup(dealt.groupBy("group")).applyInPandas(scan, "query long, entry long, score double")
    ranked = ranked.unionByName(asked_entries.mapInArrow(itself, "query long, entry long, score double"))
    keys = entries.select("entry", "k1", "k2", "least")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "entry"))
    best = common.saved(ranked.join(keys, "entry").withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("query", "entry", "k1", "k2", "score"), f"{path}/best")
    # the rows of each entry, and which of those with one id each is: a query's own row is the first of its id in its entry
    again = F.row_number().over(Window.partitionBy("k1", "k2", "id").orderBy("nth"))
    ids = best.join(few.select("k1", "k2", F.col("id").alias("vec_id"), again.alias("again")), ["k1", "k2"]).select("query", "entry", "vec_id", "again", "score")
    own = (F.col("entry") == F.col("query")) & (F.col("vec_id") == F.col("query_id")) & (F.col("again") == 1)
    asked_rows = wanted.join(keys.select("k1", "k2", F.col("entry").alias("query")), ["k1", "k2"]).select("query_id", "times", "query")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "entry", "again"))
    some = ids.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "entry", "again"))
    out = asked_rows.join(some, "query").filter(~own).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).drop("time")


def calibrate(index: Index, codes: DataFrame, asked: DataFrame, k: int) -> None:
    """Set index.probes and index.rerank to what TRIALS of the queries (query, q) need among all entries (entry, least, v,
    list, codes). Their true neighbours are found by brute force, and their places by quantised distance counted: two passes
    over the entries, each TRIALS distances an entry. Neither queries nor their neighbourhoods need be like other rows."""
    spark = codes.sparkSession
    trials = asked.orderBy(F.xxhash64("query")).limit(TRIALS).toPandas()
    if not len(trials):
        return
    names, units = trials["query"].to_numpy(), unit(np.stack(trials["q"].to_numpy()))
    shared = spark.sparkContext.broadcast((index, names, units))
    kept = "trial int, score double, list int, codes binary"

    def nearest_of(batches):
        _, names, units = shared.value
        best = [pd.DataFrame({"trial": [], "score": [], "list": [], "codes": []})]
        for b in batches:
            if not b.num_rows:
                continue
            like = unit(_matrix(b.column(1))) @ units.T
            like[b.column(0).to_numpy()[:, None] == names] = -np.inf
            m = min(k, len(like))
            rows = np.argpartition(-like, m - 1, axis=0)[:m].T.reshape(-1)
            trial = np.repeat(np.arange(len(names)), m)
            best.append(pd.DataFrame({"trial": trial, "score": like[rows, trial], "list": b.column(2).to_numpy()[rows], "codes": b.column(3).take(pa.array(rows)).to_pylist()}))
            best = [pd.concat(best[-2:]).sort_values("score", ascending=False, kind="stable").groupby("trial").head(k)]
        yield pa.RecordBatch.from_pandas(best[0].astype({"trial": "int32", "list": "int32", "score": float}), pa.schema([("trial", pa.int32()), ("score", pa.float64()), ("list", pa.int32()), ("codes", pa.binary())]), preserve_index=False)

    nth = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "list", "codes"))
    true = codes.select("entry", "v", "list", "codes").mapInArrow(nearest_of, kept).filter(F.col("score") > float("-inf"))
    true = true.withColumn("nth", nth).filter(F.col("nth") <= k).toPandas()
    if not len(true):
        return
    at = lambda v: int(np.quantile(v, REACH, method="higher")) + 1
    lists = squared(units, index.coarse)
    trial, which = true["trial"].to_numpy(), true["list"].to_numpy()
    full = np.zeros(len(index.coarse), bool)
    full[[r["list"] for r in codes.select("list").distinct().collect()]] = True
    index.probes = at(((lists[trial] < lists[trial, which][:, None]) & full).sum(1))
    code = _codes(true["codes"])
    base = lists[trial, which] + index.own(which, code)
    bounds = np.array([index.far(units[t], base[i : i + 1], code[i][:, None])[0] for i, t in enumerate(trial)])
    lists[lists > np.partition(np.where(full, lists, np.inf), min(index.probes, full.sum()) - 1, axis=1)[:, min(index.probes, full.sum()) - 1][:, None]] = np.inf
    limits = spark.sparkContext.broadcast((lists, trial, bounds))

    def places(batches):
        index, _, units = shared.value
        lists, trial, bounds = limits.value
        places = np.zeros(len(bounds), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            which, code = b.column(0).to_numpy(), _codes(b.column(1).to_pylist())
            own = index.own(which, code)
            for t, q in enumerate(units):
                some = np.flatnonzero(np.isfinite(lists[t, which]))
                of = np.flatnonzero(trial == t)
                far = np.sort(index.far(q, lists[t, which[some]] + own[some], np.ascontiguousarray(code[some].T)))
                places[of] += np.searchsorted(far, bounds[of] - 1e-12)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bounds)), pa.int32()), pa.array(places)], names=["i", "place"])

    counted = codes.select("list", "codes").mapInArrow(places, "i int, place long").groupBy("i").agg(F.sum("place").alias("place"))
    index.rerank = max(RERANK, at(counted.toPandas()["place"].to_numpy()))


def _codes(column) -> np.ndarray:
    """Codes of entries as a matrix."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
