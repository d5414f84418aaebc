"""The packing's genetic algorithm where best fit alone fails: triplets that fill a sequence exactly."""

import itertools

import numpy as np

from tidewatch.llm import packing

LENGTH = 1000


def triplets(n, seed):
    rng, out = np.random.default_rng(seed), []
    while len(out) < 3 * n:
        a, b = (int(v) for v in rng.integers(255, 495, 2))
        if 255 <= LENGTH - a - b <= 495:
            out += [a, b, LENGTH - a - b]
    return out


def checked(p, sizes):
    """The number of sequences, once every item is known to be in one, and none to be too long."""
    assert sorted(itertools.chain(*p.bins.values())) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) <= LENGTH for items in p.bins.values())
    return len(p.bins)


def numbered(p, sizes):
    out = [0] * len(sizes)
    for k, items in enumerate(p.bins.values()):
        for i in items:
            out[i] = k
    return out


def best_fit(sizes):
    p = packing._Packing(LENGTH)
    p.best_fit(range(len(sizes)), sizes)
    return p


def test_crossover_wins_sequences():
    won = 0
    for seed in range(3):
        sizes = triplets(100, seed)
        first = checked(packing.evolve(sizes, LENGTH, seed, [], 12, 0), sizes)
        later = checked(packing.evolve(sizes, LENGTH, seed, [], 12, 300), sizes)
        assert 100 <= later <= first <= checked(best_fit(sizes), sizes)
        won += first - later
    assert won > 0


def test_children_hold_injected_sequences():
    sizes, rng = triplets(60, 5), np.random.default_rng(0)
    a, b = packing.evolve(sizes, LENGTH, 1, [], 6, 0), packing.evolve(sizes, LENGTH, 2, [], 6, 20)
    whole = {frozenset(items) for items in b.bins.values()}
    for _ in range(20):
        child = packing.cross(a, b, sizes, rng)
        assert checked(child, sizes) >= 60
        assert whole & {frozenset(items) for items in child.bins.values()}
    assert checked(a, sizes) == len(a.bins)  # parents stay as they are


def test_migrants_are_never_lost():
    sizes = triplets(80, 7)
    elites = [packing.evolve(sizes, LENGTH, s, [], 12, 150) for s in (1, 2)]
    best = min(checked(e, sizes) for e in elites)
    assert checked(packing.evolve(sizes, LENGTH, 3, [numbered(e, sizes) for e in elites], 12, 150), sizes) <= best
    poor = [[i for i in range(len(sizes))], numbered(elites[0], sizes)]
    assert checked(packing.evolve(sizes, LENGTH, 4, poor, 2, 0), sizes) == len(elites[0].bins)


def test_small_instances_stay_within_one_of_the_optimum():
    for seed in range(6):
        sizes = triplets(3, seed)
        assert checked(packing.evolve(sizes, LENGTH, seed, [], 12, 400), sizes) <= 4


def test_packed_triplets(spark, tmp_path, monkeypatch):
    """The whole packing of pieces, islands and migration included: each piece once, gapless, none too long."""
    monkeypatch.setattr(packing, "POPULATION", 10)
    monkeypatch.setattr(packing, "GENERATIONS", 100)
    sizes = triplets(60, 11)
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    rows = packing.pack(pieces, f"file://{tmp_path}/p", length=LENGTH).join(pieces, "uid").collect()
    assert sorted(r.uid for r in rows) == list(range(180))
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        at = by.get(r.sequence_id, 0)
        assert r.offset == at
        by[r.sequence_id] = at + r.length
    assert max(by.values()) <= LENGTH and 60 <= len(by) <= len(best_fit(sizes).bins)
