"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

Two permutations serve all coordinates of a signature: the first (sigma) scatters shingles over a circle of places, the
second (pi) gives each place a rank, and coordinate k reads pi shifted by k. Texts with the same words are one class. Bands
of coordinates make buckets of classes. Within a bucket no pairs are listed: members are verified against centres, and then
only pairs between components that exact bounds on the first shingles of an order leave open.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

WORDS, SIMILAR = 5, 75
#: Places on the circle, bands, coordinates in a band. At a similarity of 0.75 a pair shares no band with a chance of 5e-6.
PLACES, BANDS, ROWS = 1 << 21, 32, 4
#: Members up to which all of a bucket's open pairs are verified at once.
SMALL = 16
#: Counters of how often shingles occur among the members of large buckets: 8 MB that are broadcast.
SLOTS = 1 << 21
_CHUNK = 1 << 20


def circle(places: int = PLACES, shifts: int = BANDS * ROWS, seed: int = 20240607) -> np.ndarray:
    """pi around the circle, its start repeated at the end, so that each place's shifted ranks are a slice."""
    pi = np.random.default_rng(seed).permutation(places).astype(np.uint32)
    return np.concatenate([pi, pi[:shifts]])


def sigma(h: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The place of a 64-bit hash: a bijection of the hash, then its leading bits."""
    return (T.mix(h ^ np.uint64(0xA5A5F00DD15EA5E5)) >> np.uint64(64 - (places.bit_length() - 1))).astype(np.int64)


def shingle_sets(texts: list[bytes | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, A-Z lower-cased; of the whole sequence if it has fewer."""
    w = T.words(texts, lower=True)
    h = w.hashes()
    g = T.grams(h, k)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(g[a : z - k + 1]))
        else:
            out.append(T.grams(h[a:z], z - a) ^ np.uint64(z - a) if z > a else h[:0])
    return out


def signature(shingles: np.ndarray, pi: np.ndarray, shifts: int = BANDS * ROWS) -> np.ndarray:
    """Least rank at each shift over the set's places."""
    rows = np.lib.stride_tricks.sliding_window_view(pi, shifts)
    places = np.sort(sigma(shingles, len(pi) - shifts))
    least = np.full(shifts, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(places), 4096):
        np.minimum(least, rows[places[lo : lo + 4096]].min(0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band, different from band to band."""
    acc = T.mix(np.arange(bands, dtype=np.uint64))
    for column in least.reshape(bands, -1).T:
        acc = T.mix(acc ^ column.astype(np.uint64))
    return acc.view(np.int64)


def _sequence(texts: list[bytes | None]) -> list[bytes]:
    """Digest of each text's lower-cased words."""
    return [hashlib.blake2b(b" ".join((t or b"").lower().split()), digest_size=16).digest() for t in texts]


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, words, keys) of rows (doc_id, text): words is the class, keys are null for empty sets and null ids."""

    def run(batches):
        pi = circle()
        for b in batches:
            texts, ids = T.texts_of(b), b.column(0)
            for lo, hi in T.chunks(texts, _CHUNK):
                sets = shingle_sets(texts[lo:hi])
                keys = [band_keys(signature(s, pi)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(_sequence(texts[lo:hi]), pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "words", "keys"],
                )

    return docs.mapInArrow(common.spared(run), "doc_id long, n long, words binary, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(words, shingles) of rows (doc_id, text)."""

    def run(batches):
        for b in batches:
            texts = T.texts_of(b)
            for lo, hi in T.chunks(texts, _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(_sequence(texts[lo:hi]), pa.binary()), pa.array([s.view(np.int64) for s in shingle_sets(texts[lo:hi])], pa.list_(pa.int64()))], names=["words", "shingles"])

    return docs.mapInArrow(common.spared(run), "words binary, shingles array<long>")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, link) of distinct pairs a < b, by the exact sizes of intersection and union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(two, "b").join(one, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    union = F.col("sum") - F.col("both")
    return met.select("a", "b", "both", (100 * F.col("both") >= SIMILAR * union).alias("link"))


def components(nodes: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over links (a, b). In each round every node goes to its smallest
    neighbour and on to that one's, and links are carried along; those within a component are gone, so that stars are one
    round. A node's neighbours are only ever aggregated, never gathered."""
    labels, links, step = nodes.select("node", F.col("node").alias("comp")), links.select("a", "b"), 0
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = common.saved(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), f"{path}/near{step}")
        on = near.select(F.col("a").alias("to"), F.col("to").alias("next"))
        up = common.saved(near.join(on, "to").select("a", F.col("next").alias("to")), f"{path}/up{step}")
        labels = common.saved(labels.join(up.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{path}/labels{step}")
        left, right = up.select("a", F.col("to").alias("to_a")), up.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(left, "a").join(right, "b").filter("to_a != to_b")
        links = common.saved(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"{path}/links{step}")
        if not links.limit(1).count():
            return labels
        step += 1


def _alike(n1: str, n2: str) -> F.Column:
    """Whether the sizes allow a similarity of SIMILAR percent."""
    return 100 * F.least(n1, n2) >= SIMILAR * F.greatest(n1, n2)


def _active(members: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Members, with their components, of the buckets that still hold more than one."""
    placed = members.join(labels, "node")
    open_ = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    return common.saved(placed.join(open_, "key", "left_semi"), path)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs a < b of rows (x, y)."""
    return pairs.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """Labels after more links: only the components that those touch are walked."""
    of = [labels.select(F.col("node").alias(x), F.col("comp").alias(f"of_{x}")) for x in "ab"]
    over = links.join(of[0], "a").join(of[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a != b").distinct()
    over = common.saved(over, f"{path}/over")
    nodes = over.select(F.col("a").alias("node")).unionByName(over.select(F.col("b").alias("node"))).distinct()
    moved = components(nodes, over, path).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return common.saved(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{path}/labels")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each slot (its lowest bits): SLOTS numbers, whatever the input."""
    size = SLOTS // 128

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        some = np.flatnonzero(total.reshape(-1, size).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i * size : (i + 1) * size].astype("<u4").tobytes() for i in some], pa.binary())], names=["part", "counts"])

    def add(key, f):
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in f["counts"])
        return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    out = np.zeros(SLOTS, np.uint32)
    for r in sets.select("shingles").mapInArrow(common.spared(count), "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], "<u4")
    return out


def _apart(members: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Pairs of members of large buckets in different components that could be links.

    With all shingles in one order, rarest slots among these members first, a link's first common shingle stands among the
    first quarter of both sets, and from it on both sets are at least as long as the intersection must be. Copies with
    changes of their own begin with those, so that texts too different for a link meet too late. Any order gives all links.
    """
    each = members.select("node", "n", "comp").distinct()
    own = common.saved(each.join(sets, "node"), f"{path}/own")
    shared = members.sparkSession.sparkContext.broadcast(_frequencies(own))  # 4 x SLOTS bytes

    def first(batches):
        seen = shared.value
        for b in batches:
            row, rest, shingles = [], [], []
            for i, (s, n) in enumerate(zip(b.column(3), b.column(1).to_pylist(), strict=True)):
                s = s.values.to_numpy()
                c = seen[s & (SLOTS - 1)]
                at = np.lexsort([s, c])[: n // 4 + 1]
                kept = np.flatnonzero(c[at] > 1)
                row.append(np.full(len(kept), i))
                rest.append(n - kept)
                shingles.append(s[at[kept]])
            row = pa.array(np.concatenate(row), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in range(3)], pa.array(np.concatenate(rest), pa.int64()), pa.array(np.concatenate(shingles), pa.int64())], names=["node", "n", "comp", "rest", "shingle"])

    first = common.saved(own.select("node", "n", "comp", "shingles").mapInArrow(common.spared(first), "node long, n long, comp long, rest long, shingle long"), f"{path}/first")
    other = first.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "comp", "rest")])
    late = (100 + SIMILAR) * F.least("rest", "rest2") < SIMILAR * (F.col("n") + F.col("n2"))
    met = first.join(other, "shingle").filter((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & _alike("n", "n2") & ~late)
    return _ordered(met.select(F.col("node").alias("x"), F.col("node2").alias("y")))


def _link(classes: DataFrame, sets_for, path: str) -> DataFrame:
    """(node, comp) for the classes that share a bucket with another; classes: (node, n, keys).

    Buckets with the same members (their number and 128 bits of their hashes tell) are one bucket. Every pair of a bucket
    ends in one component, or verified, or excluded by sizes or bounds: first all members are verified against two centres,
    the smallest node and one at random; then small buckets verify all open pairs between components, larger ones those
    that the bounds of _apart leave.
    """
    banded = classes.select("node", "n", F.explode("keys").alias("key"))
    one = F.struct("node", "n")
    held = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"held{i}") for i in range(2)]
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(one).alias("centre"), F.min_by(one, F.xxhash64("key", "node")).alias("other"), *held).filter("size > 1")
    same = shared.groupBy("size", "held0", "held1").agg(F.min_by(F.struct("key", "centre", "other"), "key").alias("b")).select("b.*", (F.col("size") > SMALL).alias("large"))
    members = common.saved(banded.join(same, "key"), f"{path}/members")
    nodes = common.saved(members.select("node").distinct(), f"{path}/nodes")
    sets = sets_for(nodes)
    near = members.select("node", "n", F.explode(F.array("centre", "other")).alias("c")).filter(_alike("n", "c.n"))
    pairs = _ordered(near.select(F.col("node").alias("x"), F.col("c.node").alias("y")))
    met = common.saved(_verify(pairs, sets), f"{path}/met0")
    labels = components(nodes, met.filter("link"), f"{path}/turn0")
    active = _active(members.select("key", "node", "n", "large"), labels, f"{path}/active")
    one = active.filter(~F.col("large")).select("key", "node", "n", "comp")
    two = one.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    rows = one.join(two, "key").filter((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & _alike("n", "n2"))
    pairs = _ordered(rows.select(F.col("node").alias("x"), F.col("node2").alias("y")))
    large = active.filter("large")
    if large.limit(1).count():
        pairs = pairs.unionByName(_apart(large, sets, path)).distinct()
    more = common.saved(_verify(pairs.join(met.select("a", "b"), ["a", "b"], "left_anti"), sets), f"{path}/met1")
    if more.filter("link").limit(1).count():
        labels = _merged(labels, more.filter("link"), f"{path}/turn1")
    return labels


def resolve(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets; component_id is the smallest id that
    links reach, kept tells whether that is the document itself. Empty sets (null, empty or blank texts) are linked with
    nothing. Null ids take no part: component_id is null and kept true. Rows that share an id share the fate of their own
    texts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    path = common.staging(spark)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = common.saved(_signed(named), f"{path}/signed")
    part = signed.filter("doc_id is not null and n > 0")
    found = part.groupBy("words").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    found = common.saved(found.withColumn("node", F.monotonically_increasing_id()), f"{path}/classes")
    # the keys of a class are those of any of its rows: those of its smallest id
    keyed = part.join(found.select("words", "rep", "node"), [part.words == found.words, part.doc_id == F.col("rep")]).groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))

    def sets_for(nodes: DataFrame) -> DataFrame:
        needed = found.join(nodes, "node").select("node", "words", "rep")
        texts = named.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return common.saved(_sets(texts).join(needed.select("node", "words"), "words").dropDuplicates(["node"]).select("node", "shingles"), f"{path}/sets")

    labels = _link(keyed, sets_for, path)
    tops = found.select("node", "words", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = tops.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = common.saved(tops.join(least, "comp").select("words", "component_id"), f"{path}/ids")
    joined = signed.select("doc_id", "n", "words").join(ids, "words", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
