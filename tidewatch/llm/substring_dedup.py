"""Substring deduplication on prefix-partitioned suffix trees.

Suffixes start at synchronising words: of every 50-word window, the place (the leftmost) whose 8-word prefix has the least
hash. Equal windows pick equal places, so suffixes with one 8-word prefix meet in one subtree, and a prefix that only one
document has is a leaf that never leaves its block. Repeated prefixes bring their surroundings: the words of all windows
that picked them. Equal surroundings are merged first (their smallest document id decides).

Prefixes are as long as it takes for a subtree to fit in memory: 8 words, where those have too many surroundings 12, then 18,
then 25. A window that doesn't reach so far to the right of its place reaches the further to the left, and its prefix grows
there. What is too frequent with 25 words too gets the longest prefixes there are, whole windows: a subtree is then a leaf,
whose smallest id is partially aggregated. All other subtrees are built in memory-sized groups of prefixes: sorted suffixes
with their common prefix lengths, and the same for the reversed words to the left. A window is a pair of internal nodes
whose depths, left and right, add up to the window; the smallest id below both tells which of its documents keep it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks as B
from tidewatch.llm import common
from tidewatch.llm import text as T

#: Words of a window, and of the prefix that suffixes are first grouped by.
WINDOW, PREFIX = 50, 8
#: Bytes of text in a block; its prefixes rarely repeat within it, so a small one costs no more keys.
BLOCK = 3 << 20
#: Lengths that a prefix grows to while its surroundings hold more bytes than a subtree may.
LADDER, SUBTREE = (12, 18, 25), 256 << 10
#: Bytes of surroundings in a memory-sized group.
GROUP = 12 << 20


def sync_points(w: T.Words, h: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """(place, first window, number of windows, text, prefix hash): runs of windows that pick the same place.

    Sliding minima by doubling, leftmost on ties; the picked place never moves back from one window to the next.
    """
    g = T.grams(h, prefix)
    span = window - prefix + 1
    m = len(h) - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, g[:0]
    value, place, have = g, np.arange(len(g), dtype=np.int64), 1

    def least(v1, p1, v2, p2):
        second = v2 < v1
        return np.where(second, v2, v1), np.where(second, p2, p1)

    while 2 * have <= span:
        value, place = least(value[:-have], place[:-have], value[have:], place[have:])
        have *= 2
    if have < span:
        step = span - have
        value, place = least(value[:-step], place[:-step], value[step:], place[step:])
    place = place[:m]
    doc = w.doc_of()
    at = np.flatnonzero(T.inside(w.first, window, m))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, g[:0]
    picked, owner = place[at], doc[at]
    new = np.concatenate([[True], (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return picked[first], at[first], count, owner[first], g[picked[first]]


def _prefixes(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct prefixes by part, with the smallest and largest document id."""

    def run(batches):
        for b in batches:
            for row in B.rows_of(b):
                block = B.Block(row)
                _, _, _, doc, key = sync_points(block.words, block.words.hashes())
                ok = block.known[doc] if len(doc) else np.zeros(0, bool)
                key, ids = key[ok], block.ids[doc[ok]] if len(doc) else np.zeros(0, np.int64)
                order = np.lexsort([ids, key])
                key, ids = key[order], ids[order]
                edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                u, low = key[edge], ids[edge]
                high = ids[np.append(edge[1:], len(key)) - 1] if len(key) else ids
                some, cut = B.part_bounds(u, parts)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(some, pa.int32()),
                        "block": pa.array([block.number] * len(some), pa.int64()),
                        "keys": pa.array([B.pack_keys(u[a:z]) for a, z in spans], pa.binary()),
                        "low": pa.array([B.planes(low[a:z]) for a, z in spans], pa.binary()),
                        "high": pa.array([B.planes(high[a:z]) for a, z in spans], pa.binary()),
                    }
                )

    return blocks.mapInArrow(common.spared(run), "part int, block long, keys binary, low binary, high binary")


def _repeated(asked: DataFrame) -> DataFrame:
    """For each (block, part), bits in the order of its keys: whether more than one document has the prefix."""

    def run(key, f):
        asked = [B.unpack_keys(k) for k in f["keys"]]
        u, at = np.unique(np.concatenate(asked), return_inverse=True)
        low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, at, np.concatenate([B.unplanes(x, np.int64) for x in f["low"]]))
        np.maximum.at(high, at, np.concatenate([B.unplanes(x, np.int64) for x in f["high"]]))
        again = (low < high)[at]
        cut = np.cumsum([0] + [len(a) for a in asked])
        some = [(b, again[a:z]) for b, a, z in zip(f["block"], cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame({"block": [b for b, _ in some], "part": int(key[0]), "n": [len(x) for _, x in some], "bits": [np.packbits(x).tobytes() for _, x in some]})

    return asked.groupBy("part").applyInPandas(common.spared_group(run), "block long, part int, n int, bits binary")


_PLACES = "prefix long, doc_id long, block long, doc int, lo int, left int, windows int, around binary, same binary"


def _places(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Places with repeated prefixes. around: the words of their windows; lo: the first of them in its text; left: how many
    stand before the place; windows: how many windows picked it; same: digest of around."""

    def run(left, right):
        block = B.Block(left.iloc[0])
        w = block.words
        place, first, count, doc, key = sync_points(w, w.hashes())
        ok = block.known[doc]
        u = np.unique(key[ok])
        right = right.sort_values("part")
        again = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(right["bits"], right["n"], strict=True)]).astype(bool) if len(right) else np.zeros(0, bool)
        keep = np.flatnonzero(ok)
        keep = keep[again[np.searchsorted(u, key[keep])]]
        raw = w.buf.tobytes()
        around = [b" ".join(raw[a:z].split()) for a, z in zip(w.starts[first[keep]].tolist(), w.ends[first[keep] + count[keep] + WINDOW - 2].tolist(), strict=True)]
        offset = place[keep] - first[keep]
        return pd.DataFrame(
            {
                "prefix": key[keep].view(np.int64),
                "doc_id": block.ids[doc[keep]],
                "block": block.number,
                "doc": doc[keep].astype(np.int32),
                "lo": (first[keep] - w.first[doc[keep]]).astype(np.int32),
                "left": offset.astype(np.int32),
                "windows": count[keep].astype(np.int32),
                "around": around,
                "same": [hashlib.blake2b(a, digest_size=16, salt=int(o).to_bytes(2, "little")).digest() for a, o in zip(around, offset.tolist(), strict=True)],
            }
        )

    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(common.spared_group(run), _PLACES)


def nodes_of(sequences: np.ndarray, root: np.ndarray):
    """Sorted suffixes and common lengths of rows of word numbers: a function (depth) -> each row's node at that depth."""
    order = np.lexsort([*sequences.T[::-1], root])
    s, r = sequences[order], root[order]
    equal = np.cumprod(s[1:] == s[:-1], axis=1, dtype=np.int8) if len(s) > 1 else np.zeros((0, s.shape[1]), np.int8)
    common_length = np.where(r[1:] == r[:-1], equal.sum(1), -1)

    def at_depth(depth: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(common_length < depth)]) if len(order) else []
        return out

    return at_depth


def repeats(f: pd.DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> np.ndarray:
    """For each row (key, around, left, nearest, farthest, low) a bit set: bit k tells whether its k-th window, if its place
    stands nearest to farthest words after the window's start, is also one of a row with this key and a smaller low."""
    w = T.words(list(f["around"]))
    _, word = np.unique(w.hashes(), return_inverse=True)
    word = word.astype(np.int32)
    _, root = np.unique(f["key"].to_numpy(), return_inverse=True)
    left, nearest, farthest, low = (f[c].to_numpy(np.int64) for c in ("left", "nearest", "farthest", "low"))
    place = w.first[:-1] + left
    reach = window - prefix + 1
    padded = np.concatenate([word, np.full(window, -1, np.int32)])
    right = padded[place[:, None] + np.arange(window)]
    right[np.arange(window) >= (w.first[1:] - place)[:, None]] = -1
    back = place[:, None] - 1 - np.arange(reach)
    before = np.where(back >= w.first[:-1][:, None], word[np.maximum(back, 0)], -1).astype(np.int32)
    right_node, left_node = nodes_of(right, root), nodes_of(before, root)
    hit = np.zeros(len(f), np.int64)
    for offset in range(reach):  # the place's distance from the window's first word
        here = np.flatnonzero((offset <= farthest) & (offset >= nearest))
        if not len(here):
            continue
        pair = right_node(window - offset)[here] * np.int64(len(f) + 1) + left_node(offset)[here]
        u, at = np.unique(pair, return_inverse=True)
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, at, low[here])
        hit[here] |= (least[at] < low[here]).astype(np.int64) << (left[here] - offset)
    return hit


_ROW = "prefix long, same binary, low long, around binary, left int, nearest int, farthest int, right int, before int"


def _longer(length: int):
    """Rows with prefixes of length words: for windows that reach that far from their place, to the right; for the others a
    row of their own, whose prefix has the words on the left that all of them hold."""

    def run(batches):
        for b in batches:
            f = b.to_pandas()
            far = WINDOW - length
            one, two = f[f["nearest"] <= far].copy(), f[f["farthest"] > far].copy()
            one["farthest"] = np.minimum(one["farthest"], far).astype(np.int32)
            one["right"] = np.int32(length)
            two["nearest"] = np.maximum(two["nearest"], far + 1).astype(np.int32)
            two["before"] = np.maximum(two["before"], far + 1).astype(np.int32)
            out = pd.concat([one, two], ignore_index=True)
            key = []
            for around, left, right, before in zip(out["around"], out["left"].tolist(), out["right"].tolist(), out["before"].tolist(), strict=True):
                words = b" ".join(around.split(b" ")[left - before : left + right])
                key.append(int.from_bytes(hashlib.blake2b(words, digest_size=8, salt=bytes([right, before])).digest(), "little", signed=True))
            out["key"] = np.array(key, np.int64)
            yield pa.RecordBatch.from_pandas(out, schema=pa.schema([(c, {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}[t]) for c, t in (x.split() for x in f"{_ROW}, key long".split(", "))]), preserve_index=False)

    return run


def _windows(batches):
    """Every window of rows by a 128-bit digest: the longest prefixes."""
    for b in batches:
        f = b.to_pandas()
        out: list[tuple] = []
        for prefix, same, low, around, left, nearest, farthest in zip(*(f[c] for c in ("prefix", "same", "low", "around", "left", "nearest", "farthest")), strict=True):
            words = around.split(b" ")
            for k in range(left - farthest, left - nearest + 1):
                out.append((hashlib.blake2b(b" ".join(words[k : k + WINDOW]), digest_size=16).digest(), prefix, same, low, 1 << k))
        digest, prefix, same, low, bit = zip(*out, strict=True) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(prefix, pa.int64()), pa.array(same, pa.binary()), pa.array(low, pa.int64()), pa.array(bit, pa.int64())], names=["digest", "prefix", "same", "low", "bit"])


def _marks(places: DataFrame, path: str, subtree: int) -> DataFrame:
    """(same, prefix, low, hit): for each distinct surrounding its smallest document, and a bit set of its windows that a
    smaller one has."""
    spark = places.sparkSession
    distinct = places.groupBy("prefix", "same").agg(F.min("doc_id").alias("low"), F.first("around").alias("around"), F.first("left").alias("left"), F.first("windows").alias("windows"))
    distinct = common.saved(distinct, f"{path}/distinct")
    rows = distinct.withColumns({"nearest": F.col("left") - F.col("windows") + 1, "farthest": F.col("left"), "right": F.lit(PREFIX), "before": F.lit(0), "key": F.col("prefix")}).drop("windows")
    fit, total = [], 0
    for level in range(len(LADDER) + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("around")).alias("bytes")).filter("n > 1")
        sizes = common.saved(sizes, f"{path}/sizes{level}")
        small, large = sizes.filter(F.col("bytes") <= subtree), sizes.filter(F.col("bytes") > subtree)
        fit.append(rows.join(small.select("key").hint("merge"), "key").select("prefix", "same", "low", "around", "left", "nearest", "farthest", "key"))
        total += small.agg(F.sum("bytes")).first()[0] or 0
        if not large.limit(1).count():
            rows = None
            break
        rows = rows.join(large.select("key").hint("merge"), "key").select(*[x.split()[0] for x in _ROW.split(", ")])
        if level < len(LADDER):
            rows = common.saved(rows.mapInArrow(common.spared(_longer(LADDER[level])), f"{_ROW}, key long"), f"{path}/rows{level}")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))

    def tree(key, f):
        hit = repeats(f)
        return pd.DataFrame({"same": f["same"], "prefix": f["prefix"], "hit": hit})[hit != 0]

    grouped = reduce(DataFrame.unionByName, fit).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    hits = grouped.groupBy("group").applyInPandas(common.spared_group(tree), "same binary, prefix long, hit long")
    if rows is not None:
        expanded = common.saved(rows.mapInArrow(common.spared(_windows), "digest binary, prefix long, same binary, low long, bit long"), f"{path}/windows")
        least = expanded.groupBy("digest").agg(F.min("low").alias("least"))
        hits = hits.unionByName(expanded.join(least, "digest").filter("least < low").select("same", "prefix", F.col("bit").alias("hit")))
    hits = hits.groupBy("same", "prefix").agg(F.bit_or("hit").alias("hit"))
    marks = distinct.select("same", "prefix", "low").join(hits.hint("merge"), ["same", "prefix"], "left")
    out = common.saved(marks, f"{path}/marks")
    common.release(spark)
    return out


def covered_words(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n_words are in a window that begins at one of starts."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + window, n_words), 1)
    return np.cumsum(step[:n_words]) > 0


def cut_text(raw: bytes, starts: list[int], ends: list[int], gone: np.ndarray) -> bytes:
    """What is left of raw, the white space between kept neighbours unchanged. Where words went there is a line break, if
    there was one around or between them, else a blank."""
    keep = np.flatnonzero(~gone).tolist()
    if not keep:
        return b""
    out, first = [], keep[0]
    for a, b in zip(keep, [*keep[1:], None], strict=True):
        if b != a + 1:
            out.append(raw[starts[first] : ends[a]])
            if b is not None:
                out.append(b"\n" if b"\n" in raw[ends[a] : starts[b]] else b" ")
                first = b
    return b"".join(out)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, subtree: int = SUBTREE, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a 50-word window over it also starts in a document with a smaller id; windows are judged on the input.
    kept_sha256 is that of the kept words, joined by a space. with_text adds kept, what is left of a text that loses a word
    (see cut_text), null for any other; row_col: a long without nulls that is returned as row. Null and empty texts have no
    words. Rows with a null id keep all and are no one's earlier copy; rows that share an id aren't each other's. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = common.staging(spark)
    blocks = B.write(docs, f"{path}/blocks", id_col=id_col, text_col=text_col, row_col=row_col, limit=BLOCK)
    repeated = common.saved(_repeated(_prefixes(blocks, B.parts_of(blocks))), f"{path}/repeated")
    places = common.saved(_places(blocks, repeated), f"{path}/places")
    common.release(spark)
    marks = _marks(places, path, subtree)
    # all windows of a copy beyond the smallest document; of that one, those that a smaller document has elsewhere
    found = places.select("prefix", "same", "doc_id", "block", "doc", "lo", "windows").join(marks.hint("merge"), ["prefix", "same"])
    found = found.filter((F.col("doc_id") > F.col("low")) | F.col("hit").isNotNull())
    flagged = common.saved(found.select("block", "doc", "lo", "windows", F.when(F.col("doc_id") > F.col("low"), F.lit(-1)).otherwise(F.col("hit")).alias("hit")), f"{path}/flagged")
    common.release(spark)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text + ", row long" * bool(row_col)

    def finish(left, right):
        block = B.Block(left.iloc[0])
        w = block.words
        right = right.sort_values(["doc", "lo"])
        doc, lo, count, hit = (right[c].to_numpy() for c in ("doc", "lo", "windows", "hit"))
        cut = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        rows = []
        for i, t in enumerate(block.texts):
            words = t.split()
            starts = []
            for k in range(cut[i], cut[i + 1]):
                some = np.arange(count[k])
                starts.append(lo[k] + some[(int(hit[k]) >> some) & 1 == 1])
            gone = covered_words(len(words), np.concatenate(starts).astype(np.int64)) if starts else None
            kept = words if gone is None else [x for x, g in zip(words, gone, strict=True) if not g]
            row = [int(block.ids[i]) if block.known[i] else None, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()]
            if with_text:
                a, z = w.first[i], w.first[i + 1]
                row.append(cut_text(t, (w.starts[a:z] - w.at[i]).tolist(), (w.ends[a:z] - w.at[i]).tolist(), gone).decode("utf-8", "replace") if len(kept) < len(words) else None)
            rows.append((*row, int(block.rows[i])) if row_col else tuple(row))
        f = pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])
        f["doc_id"] = f["doc_id"].astype("Int64")
        return f

    return blocks.groupBy("block").cogroup(flagged.groupBy("block")).applyInPandas(common.spared_group(finish), out)
