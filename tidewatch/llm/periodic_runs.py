"""Periodic runs of words: the maximal stretches that repeat a block of q words at least so many times.

Each text goes through a suffix automaton over its words. Its states are visited from long to short, and their ordered sets
of end positions are merged small to large; two positions that become neighbours in a state's set, no further apart than the
state is long, end the two halves of a square. The squares are extended to runs.

Words that can't belong to a run stay out of the automaton. Where a run of period q has 4q words, every word after the first
q begins (but for the last two) a window of three words that was there at most q words before, and those windows form a
stretch of 3q - 2 at least. Stretches of windows are cut where the nearest earlier occurrence is too far for the stretch's
length, again and again until nothing changes; what is left, with the words before that its periods may reach, is searched.
Fingerprints of windows only let words in, never keep them out: the automaton compares words themselves.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

#: A run has TIMES times its period's words at least, and LEAST.
TIMES, LEAST = 4, 6
#: Positions in a piece of an ordered set.
PIECE = 2048


class Ordered:
    """An ordered set of integers in pieces, so that adding one moves few others."""

    def __init__(self, first: int):
        self.pieces, self.size = [[first]], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put in x, which isn't there yet, and return its neighbours."""
        pieces = self.pieces
        k = 0
        if len(pieces) > 1:
            lo, hi = 0, len(pieces) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if pieces[mid][0] <= x:
                    lo = mid
                else:
                    hi = mid - 1
            k = lo
        piece = pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else (pieces[k - 1][-1] if k else None)
        after = piece[at] if at < len(piece) else (pieces[k + 1][0] if k + 1 < len(pieces) else None)
        piece.insert(at, x)
        self.size += 1
        if len(piece) > PIECE:
            pieces[k : k + 1] = [piece[: PIECE // 2], piece[PIECE // 2 :]]
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths and end positions (-1 for copies of states) of the states; the first is the root."""
    step, link, size, end = [{}], [-1], [0], [-1]
    last = 0
    for i, w in enumerate(words):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(-1)
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return link, size, end


def squares(words: list, times: int = TIMES) -> dict[tuple[int, int], int]:
    """(start, distance) of repetitions and the last end position seen of each: states' new neighbours whose distance goes
    times - 1 times into the state's length."""
    link, size, end = automaton(words)
    ends: list[Ordered | None] = [Ordered(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(size[1:], np.int64), kind="stable") + 1:
        u = link[v]
        most = size[u] // (times - 1)
        if not most:
            continue
        mine, theirs = ends[v], ends[u]
        ends[v] = None
        if theirs is None:
            ends[u] = mine
            continue
        if theirs.size < mine.size:
            mine, theirs = theirs, mine
        for x in mine:
            before, after = theirs.add(x)
            for i, j in ((before, x), (x, after)):
                if i is not None and j is not None and j - i <= most:
                    key = (i - size[u] + 1, j - i)
                    found[key] = max(found.get(key, j), j)
        ends[u] = theirs
    return found


def suspects(w: T.Words, times: int = TIMES) -> list[list[tuple[int, int]]]:
    """For each text the ranges of its words that may hold runs."""
    h = w.hashes()
    g = T.grams(h, 3)
    out: list[list[tuple[int, int]]] = [[] for _ in w.at]
    if not len(g):
        return out
    doc = w.doc_of()[: len(g)]
    key = T.mix(g ^ T.mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    away = np.full(len(g), len(h) + 1, np.int64)
    away[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero((away <= len(h)) & T.inside(w.first, 3, len(g)))
    while True:  # stretches of windows; each pass takes out windows, so that it ends
        new = np.concatenate([[True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])]) if len(at) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        size = np.bincount(which, minlength=1)[which] if len(at) else which
        most = (size + 2) // (times - 1)
        ok = away[at] <= most
        if ok.all():
            break
        at = at[ok]
    for a, n, q in zip(at[new].tolist(), size[new].tolist(), most[new].tolist(), strict=True):
        d, base = int(doc[a]), int(w.first[doc[a]])
        lo, hi = max(0, a - base - q), a - base + n + 2
        while out[d] and lo <= out[d][-1][1]:
            lo = min(lo, out[d].pop()[0])
        out[d].append((lo, hi))
    return out


def runs(words: list, ranges: list[tuple[int, int]] | None = None, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ranges: where to look, everywhere by default."""
    n = len(words)
    best: dict[tuple[int, int], int] = {}
    for lo, hi in [(0, n)] if ranges is None else ranges:
        seen: set[tuple[int, int]] = set()
        for (at, q), last in squares(words[lo:hi], times).items():
            start, end = lo + at, lo + last + 1
            while start > 0 and words[start - 1] == words[start - 1 + q]:
                start -= 1
            if (start, q) in seen:
                continue
            seen.add((start, q))
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, times * q):
                best[start, end] = min(q, best.get((start, end), q))
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words outside runs and in the first period of the runs they are in."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted(n: int, doc_id: int) -> np.ndarray | None:
    """Of a tenth of the documents, by id: which word stands at each place once a stretch of its words has been repeated to
    its end, as often as the id says; None for others. A way to have runs of known size in any text."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


_RUNS = "array<struct<start:long,length:long,period:long>>"


def find(docs: DataFrame, *, plant: bool = False, times: int = TIMES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period in words), collapsed (the text that is
    left when each run keeps its first period, words joined by one space).

    plant: alter a tenth of the texts as in planted() before looking; rows with a null doc_id stay as they are. times and
    least: a run has at least times its period's words, and least; these are 3 and 4 themselves at least. Null and empty texts have no word
    and an empty collapsed text. Repeated rows each give a row. An empty table gives an empty result.
    """
    if times < 3 or least < 4:
        raise ValueError("the windows that are looked at need runs of three periods and four words at least")
    common.ship(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), T.texts_of(b)
            for lo, hi in T.chunks(texts):
                some, split = texts[lo:hi], [(t or b"").split() for t in texts[lo:hi]]
                if plant:
                    for k, i in enumerate(ids[lo:hi]):
                        at = None if i is None else planted(len(split[k]), i)
                        if at is not None:
                            split[k] = [split[k][j] for j in at.tolist()]
                            some[k] = b" ".join(split[k])
                found = [runs(s, r, times, least) if r else [] for s, r in zip(split, suspects(T.words(some), times), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids[lo:hi], pa.int64()),
                        "n_words": pa.array([len(s) for s in split], pa.int64()),
                        "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        "collapsed": pa.array([b" ".join(collapsed(s, f)) for s, f in zip(split, found, strict=True)], pa.binary()).cast(pa.string()),
                    }
                )

    return named.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """From rows of find(): doc_id, n_runs, the longest run (smallest start, then period, of several), its exponent in
    thousandths, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
