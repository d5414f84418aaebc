"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces are dealt over shards of bounded size; on each shard a few islands evolve packings, in which a gene is a whole
sequence. Crossover injects well-filled sequences of one parent into the other, drops sequences that now hold a piece
twice, and puts displaced pieces back by best fit. Between epochs islands of a shard exchange their elites. What the
shards leave in badly filled sequences is pooled and packed again, until one shard holds the pool or it stops shrinking.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import bpe, common
from tidewatch.llm import text as T

LENGTH = 2048
#: Pieces in a shard, on average.
SHARD = 8192
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 8
#: Sequences filled less than this go to the next pool.
WELL_FILLED = 0.99
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    head = n % length or min(n, length)
    return [(0, head)] + [(s, length) for s in range(head, n, length)]


def pieces_of(docs: DataFrame, *, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; ids stay in the task that makes them."""
    common.ship(docs.sparkSession)
    where = vocabulary or bpe.vocabulary()
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        encoder = bpe.encoder(where)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = T.texts_of(b)
            for lo, hi in T.chunks(texts):
                ids, bound = encoder.many(texts[lo:hi], end)
                row, made = [], []
                for i, (a, z) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
                    for k, (s, n) in enumerate(cut(z - a, length)):
                        row.append(lo + i)
                        made.append((k, s, n, zlib.crc32(ids[a + s : a + s + n])))
                k, s, n, crc = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return named.mapInArrow(common.spared(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Packing:
    """Sequences by slot; the open ones are found by free room through a bit set."""

    def __init__(self, length: int):
        self.length, self.bins, self.room, self.by_room, self.mask = length, {}, {}, {}, 0
        self.next = 0

    def copy(self) -> _Packing:
        out = _Packing(self.length)
        out.bins = {k: v[:] for k, v in self.bins.items()}
        out.room, out.mask, out.next = dict(self.room), self.mask, self.next
        out.by_room = {k: set(v) for k, v in self.by_room.items()}
        return out

    def _file(self, slot: int, room: int) -> None:
        self.room[slot] = room
        self.by_room.setdefault(room, set()).add(slot)
        self.mask |= 1 << room

    def _unfile(self, slot: int) -> int:
        room = self.room.pop(slot)
        slots = self.by_room[room]
        slots.discard(slot)
        if not slots:
            self.mask &= ~(1 << room)
        return room

    def add(self, items: list[int], used: int) -> None:
        self.bins[self.next] = items
        self._file(self.next, self.length - used)
        self.next += 1

    def remove(self, slot: int) -> list[int]:
        self._unfile(slot)
        return self.bins.pop(slot)

    def best_fit(self, items, sizes) -> None:
        """Put each item where the least room is left; longest first."""
        for i in sorted(items, key=lambda i: -sizes[i]):
            fits = self.mask >> sizes[i]
            if fits:
                room = sizes[i] + (fits & -fits).bit_length() - 1
                slot = next(iter(self.by_room[room]))
                self._unfile(slot)
                self.bins[slot].append(i)
                self._file(slot, room - sizes[i])
            else:
                self.add([i], sizes[i])

    def fitness(self) -> tuple[int, float]:
        """Fewer sequences first; then unevenly filled ones, which leave room in few places."""
        return -len(self.bins), sum((self.length - r) ** 2 for r in self.room.values())


def cross(a: _Packing, b: _Packing, sizes, rng) -> _Packing:
    """A child of a, with some of b's well-filled sequences injected whole."""
    child = a.copy()
    full = sorted(b.bins, key=lambda s: b.room[s])
    pick = full[: max(1, len(full) // 2)]
    chosen = [pick[i] for i in rng.choice(len(pick), max(1, len(pick) // 4), replace=False)]
    inject = [b.bins[s] for s in chosen]
    there = {i for items in inject for i in items}
    loose: list[int] = []
    for slot in [s for s, items in child.bins.items() if not there.isdisjoint(items)]:
        loose += [i for i in child.remove(slot) if i not in there]
    for slot, items in zip(chosen, inject, strict=True):
        child.add(items[:], b.length - b.room[slot])
    # the emptiest sequences are dissolved too
    for slot in sorted(child.bins, key=lambda s: -child.room[s])[: max(1, len(child.bins) // 50)]:
        loose += child.remove(slot)
    child.best_fit(loose, sizes)
    return child


def evolve(sizes: list[int], length: int, seed: int, elites: list[list[int]], population: int, generations: int) -> _Packing:
    """The best packing found of items 0.. with these sizes. elites: packings as a sequence number for each item."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // length)
    people = []
    for e in elites:
        p, by = _Packing(length), {}
        for i, k in enumerate(e):
            by.setdefault(k, []).append(i)
        for items in by.values():
            p.add(items, sum(sizes[i] for i in items))
        people.append(p)
    if not people:
        first = _Packing(length)
        first.best_fit(range(len(sizes)), sizes)
        people.append(first)
    while len(people) < population and max(p.fitness()[0] for p in people) < -least:
        p = _Packing(length)
        for part in np.array_split(rng.permutation(len(sizes)), 4):  # best fit on parts that come one after the other
            p.best_fit(part.tolist(), sizes)
        people.append(p)
    for _ in range(generations):
        people.sort(key=_Packing.fitness, reverse=True)
        if len(people[0].bins) <= least or len(people) < 2:
            break
        mate = people[1 + int(rng.integers(len(people) - 1))]
        for child in (cross(people[0], mate, sizes, rng), cross(mate, people[0], sizes, rng)):
            if child.fitness() > people[-1].fitness():
                people[-1] = child
    return max(people, key=_Packing.fitness)


def _pack_level(loose: DataFrame, shards: int, level: int, path: str, length: int) -> DataFrame:
    """(uid, length, sequence_id, offset, used) for pieces (uid, length): shards x islands, epochs with migration."""
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).cast("int"))

    def islands(seed: int):
        def run(key, f):
            f = f.sort_values(["uid", "elite"], kind="stable")
            shard, island = int(key[0]), int(key[1])
            names = [e for e in sorted(f["elite"].unique())]
            own = f[f["elite"] == names[0]]
            sizes = own["length"].tolist()
            elites = [f.loc[f["elite"] == e, "bin"].tolist() for e in names if e >= 0]
            best = evolve(sizes, length, seed * 1_000_003 + shard * 101 + island, elites, POPULATION, GENERATIONS)
            bins = np.zeros(len(sizes), np.int64)
            for k, items in enumerate(best.bins.values()):
                bins[items] = k
            n, spread = best.fitness()
            return pd.DataFrame({"shard": shard, "island": island, "uid": own["uid"], "length": own["length"], "bin": bins, "n_bins": -n, "spread": float(spread)})

        return run

    out = "shard int, island int, uid long, length long, bin long, n_bins long, spread double"
    start = dealt.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "uid", "length", F.lit(-1).alias("elite"), F.lit(0).cast("long").alias("bin"))
    found = common.saved(start.groupBy("shard", "island").applyInPandas(common.spared_group(islands(0)), out), f"{path}/epoch0")
    for epoch in range(1, EPOCHS):
        # elites move along a ring: each island gets its own and its neighbour's
        moved = found.select("shard", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("to"), "island", "uid", "length", "bin")
        seeds = moved.select("shard", F.col("to").alias("island"), "uid", "length", F.col("island").alias("elite"), "bin")
        found = common.saved(seeds.groupBy("shard", "island").applyInPandas(common.spared_group(islands(epoch)), out), f"{path}/epoch{epoch}")

    best = found.groupBy("shard").agg(F.min_by("island", F.struct("n_bins", -F.col("spread"), "island")).alias("island"))

    def places(f):
        f = f.sort_values(["bin", "length", "uid"], ascending=[True, False, True], kind="stable")
        by = f.groupby("bin", sort=False)
        return pd.DataFrame({"uid": f["uid"], "length": f["length"], "sequence_id": by["uid"].transform("min"), "offset": by["length"].cumsum() - f["length"], "used": by["length"].transform("sum")})

    chosen = found.join(best, ["shard", "island"])
    return common.saved(chosen.groupBy("shard").applyInPandas(places, "uid long, length long, sequence_id long, offset long, used long"), f"{path}/places")


def pack(pieces: DataFrame, path: str, *, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(uid, sequence_id, offset) for every row (uid, length) of pieces; uid is unique, lengths are 1 to length."""
    slim = pieces.select("uid", "length")
    done = [slim.filter(F.col("length") >= length).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    loose, level = slim.filter(F.col("length") < length), 0
    n = loose.count()
    while n:
        shards = max(1, -(-n // shard))
        placed = _pack_level(loose, shards, level, f"{path}/level{level}", length)
        poor = placed.filter(F.col("used") < F.lit(WELL_FILLED * length))
        left = poor.count()
        if shards == 1 or 2 * left > n or not left:  # nothing to win from a further pool
            done.append(placed.select("uid", "sequence_id", "offset"))
            break
        done.append(placed.filter(F.col("used") >= F.lit(WELL_FILLED * length)).select("uid", "sequence_id", "offset"))
        loose, level, n = poor.select("uid", "length"), level + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece with the end id alone. Null and repeated ids are packed like any others, row by row.
    Only documents longer than length are cut. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = common.staging(spark)
    made = pieces_of(docs, vocabulary=vocabulary, length=length, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = common.saved(made.withColumn("uid", F.monotonically_increasing_id()), f"{path}/pieces")
    placed = pack(pieces, path, length=length)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
