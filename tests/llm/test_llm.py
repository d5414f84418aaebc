"""The operators against brute force on small tables with nulls, empty and long texts, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, bpe, language_id, license_scan, lm_scoring, near_dups, packing, quality_rules, sentence_pieces, substring_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key int, words string, node long, n int, block string"


def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out, passage, base = [], text(80), text(120).split()
    for i in range(40):
        t = text(rng.randint(0, 150))
        if i % 5 == 0:
            t = t + "\n" + passage + " " + text(5)
        if i % 7 == 3:
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = "  ".join(w).upper() if i % 2 else "\n".join(w)
        out.append((i, t))
    out += [(40, None), (41, ""), (42, " \n\t "), (None, passage), (43, text(30000)), (44, "x " * 300), (45, "Ünï 12 !! a\u0085b ▁"), (7, out[7][1]), (7, text(60)), (46, out[12][1]), (47, "a  b   c \n d ")]
    return [(i, t, ["aa", "bb", None][(i or 0) % 3], f"s{(i or 0) % 2}", None, "u", 1, "w", 2, 3, "b") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


def by_none(values):
    return sorted(values, key=lambda x: tuple((v is None, v) for v in x))


def test_substring_dedup(docs, empty):
    all_rows = [(r[0], WORD.findall(r[1] or "")) for r in rows()]
    low = {}
    for i, w in all_rows:
        for k in range(len(w) - 49):
            if i is not None:
                g = tuple(w[k : k + 50])
                low[g] = min(low.get(g, i), i)
    want = []
    for i, w in all_rows:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and low[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 300
    for subtree in (substring_dedup.SUBTREE, 2000, 1):  # 1: every repeated prefix grows to whole windows
        assert key(substring_dedup.remove_repeats(docs, subtree=subtree), "doc_id", "n_words", "n_removed", "kept_sha256") == by_none(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_near_dups(docs, empty, spark, monkeypatch):
    sets = []
    for r in rows():
        w = re.findall(WORD, (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((r[0], {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = by_none([(i, len(s), None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, s) in enumerate(sets)])
    assert sum(not w[3] for w in want) >= 4
    for small in (near_dups.SMALL, 1):  # 1: all buckets are large ones
        monkeypatch.setattr(near_dups, "SMALL", small)
        assert key(near_dups.resolve(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dups.resolve(empty).count() == 0


def test_circulant_signature_estimates_similarity():
    rng, pi = np.random.default_rng(0), near_dups.circle()
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (near_dups.signature(base, pi) == near_dups.signature(other, pi)).mean()
    assert abs(same - 800 / 1200) < 0.15


def test_license_scan(spark, empty, monkeypatch):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    wrapped = "MIT License\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.replace(" ", "\n", 3).replace("NONINFRINGEMENT", "non-infringement").replace("non-infringement", "NONINFRINGEMENT").upper()
    cases = [(1, wrapped), (2, "Hello.\n * released under the MIT licence!\nBye"), (3, None), (4, ""), (5, mit + " or else"), (5, mit + " or else")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(cases, "doc_id long, text string").withColumn("digest", F.lit(1))).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and (got[2].n_license_lines, got[2].line_licenses) == (1, "MIT")
    assert got[3].digest is None and got[4].digest == hashlib.sha256(b"").hexdigest() and got[5].license_id is None and len(got) == 5
    assert license_scan.scan(empty).count() == 0
    texts = dict(license_scan.known_texts())
    notices = ["Copyright Jane Doe", "Copyright: 2020 X", "Portions Copyright (c) 1999 Y", "// © 2001 Z", "Copyright ACME Inc.", "ALL RIGHTS RESERVED"]
    cases = [(i, n + "\n" + texts["GPL-2.0-only"].replace("  ", " ").replace("\n\n", "\n")) for i, n in enumerate(notices)]
    cases += [(100 + i, t) for i, t in enumerate(texts.values())] + [(200, "\n".join(mit.split()))]
    for few in (license_scan.FEW_KNOWN, 0):
        monkeypatch.setattr(license_scan, "FEW_KNOWN", few)
        got = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
        assert {got[i] for i in range(len(notices))} == {"GPL-2.0-only"} and got[200] == "MIT"
        assert all(got[100 + i] is not None for i in range(len(texts)))
        assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0"} <= set(got.values())


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[100:200] = v[100]  # equal vectors: ties go to smaller ids
    data = [(i, [float(x) for x in v[i]], i) for i in range(600)] + [(600, None, 1), (650, [0.0] * 8, 1), (700, [float("nan")] * 8, 1), (750, [None] * 8, 1), (None, [1.0] * 8, 1), (800, [1.0] * 3, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, query long")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = v.astype(float)
    hits = 0
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        s = ann.cosine(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort([np.arange(600), -s]) if i != q][:5]
        hits += len(set(order) & {i for i, _ in found})
        assert len(found) == 5 and all(abs(s[i] - score) < 1e-12 for i, score in found)
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert hits / (5 * len(got)) >= 0.9
    assert ann.search(df.limit(0)).count() == 0
    few = {r.query_id: r.vec_id for r in ann.search(df.filter("vec_id in (0, 3)")).collect()}
    assert few == {0: 3}
    other = spark.createDataFrame([(800, [1.0] * 3, 1), (801, [1.0, 1.0, 0.0], 1), (0, [1.0] * 2, 1), (2, [2.0] * 2, 1)], df.schema)
    assert key(ann.search(other), "query_id", "rank", "vec_id") == [(0, 1, 2), (800, 1, 801)]


def brute_force(rows, k=5):
    """Each query row's k nearest other rows, by definition; rows: (id, vector)."""
    x = np.array([v for _, v in rows], float)
    out = []
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            s = ann.cosine(np.broadcast_to(x[i], x.shape), x)
            order = [j for j in sorted(range(len(rows)), key=lambda j: (-s[j], rows[j][0])) if j != i][:k]
            out += [(q, r + 1, rows[j][0], round(float(s[j]), 12)) for r, j in enumerate(order)]
    return sorted(out)


def test_nearest_neighbours_with_repeated_ids(spark):
    """Rows are what is searched: ids may stand on several vectors, vectors under several ids, and whole rows twice."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(3)) for i in range(300)]
    rows += [(50, rng.normal(size=8).round(3)), (7, rng.normal(size=8).round(3)), (7, rng.normal(size=8).round(3)), (100, rows[100][1]), (100, rows[100][1]), (0, rows[1][1]), (1, rows[0][1])]
    rows += [(7, rows[0][1] + 0.001), (7, rows[0][1] + 0.001), (9, rows[0][1] * 2), (8, rows[0][1] * 2), (250, rows[0][1])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(df, rerank=400).collect())
    want = brute_force(rows)
    assert len(got) == len(want)
    assert got == want


def test_nearest_neighbours_of_clustered_vectors(spark, monkeypatch):
    """Where vectors have clusters, few lists hold a query's neighbours."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    rows = [(i, centres[i % 60] + rng.normal(0, 0.15, 16)) for i in range(3000)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    made = []
    real = ann.Index.__init__
    monkeypatch.setattr(ann.Index, "__init__", lambda self, *a: (real(self, *a), made.append(self))[0])
    got = {(r.query_id, r.vec_id) for r in ann.search(df).collect()}
    want = {(q, v) for q, _, v, _ in brute_force(rows)}
    assert len(got & want) >= 0.95 * len(want)
    assert made[0].probes <= 0.25 * len(made[0].coarse)


def test_nearest_neighbours_of_queries_unlike_other_rows(spark):
    """Queries that stand together, away from all other rows, are a fiftieth of these: lists and candidates suit them too.
    Half of them are multiples of one vector, all as near as each other."""
    rng = np.random.default_rng(4)
    n = 20_000
    x = rng.normal(size=(n, 16))
    x[::50] = rng.normal(size=16) + rng.normal(0, 0.01, (n // 50, 16))
    x[::100] = rng.normal(size=16) * np.exp2(rng.integers(-40, 40, n // 100))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).repartition(4)
    got = {(r.query_id, r.vec_id) for r in ann.search(df).collect()}
    want = {(q, v) for q, _, v, _ in brute_force_of(x, np.arange(0, n, 50))}
    assert len(want) == len(got) == n // 10
    assert len(got & want) >= 0.97 * len(want)
    multiples = {(q, v) for q, v in want if q % 100 == 0}
    assert multiples <= got


def brute_force_of(x, queries, k=5):
    """brute_force() of rows numbered from 0."""
    for q in queries.tolist():
        s = ann.cosine(np.broadcast_to(x[q], x.shape), x)
        s[q] = -np.inf
        yield from ((q, r + 1, int(j), s[j]) for r, j in enumerate(np.lexsort([np.arange(len(x)), -s])[:k]))


def recall(spark, path):
    """Share of all queries' 5 nearest vectors, by brute force, that the search finds."""
    table = spark.read.parquet(path)
    rows = [r for r in table.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = ann.cosine(np.broadcast_to(x[q], x.shape), x)
        hits += len(got[ids[q]] & {int(ids[i]) for i in [i for i in np.lexsort([ids, -s]) if i != q][:5]})
    return hits / (5 * len(got))


def test_nearest_neighbours_recall(spark, monkeypatch):
    assert recall(spark, "/root/testdata/sf0.01/embeddings.parquet") >= 0.95
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet") >= 0.95
    # a sample of a quarter of the vectors, and two levels of lists
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "COARSE", 16)
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet") >= 0.9


def test_quality_rules(spark, docs, empty):
    def brute(t):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    got = key(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == by_none([(r[0], *brute(r[1])) for r in rows()])
    assert quality_rules.judge(empty).count() == 0
    rng = random.Random(1)
    many = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(100)), "xx", "s") for i in range(200)]
    many += [(1000 + i, " ".join("%%%$$$###" + rng.choice("abcdefgh") for _ in range(100)), "xx", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(many, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(20))


def direct(t):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.vocabulary())
    return [tk.encode(x, add_special_tokens=False).ids + [0] for x in t]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, empty, spark, tmp_path):
    ids = direct([r[1] or "" for r in rows()])
    got = token_files.write_and_digest(docs, path=f"file://{tmp_path}/ids").orderBy("start").collect()
    assert by_none([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]) == by_none([(r[0], len(x), crc(x)) for r, x in zip(rows(), ids, strict=True)])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    one = token_files.read(spark, f"file://{tmp_path}/ids").filter("doc_id = 3").collect()
    assert one[0].ids == ids[3]
    assert token_files.write_and_digest(empty).count() == 0


def scanned(df):
    """Rows that the scan of a plan gave out, once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_token_files_prune(spark, tmp_path):
    many = spark.range(0, 16000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    path = f"file://{tmp_path}/ids"
    token_files.write(many, path)
    assert len(list((tmp_path / "ids").glob("*.orc"))) > 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = token_files.read(spark, path)
        assert scanned(files) == 8000
        assert 0 < scanned(files.filter("doc_id = 5000")) <= 1000  # a row group, by file statistics and the row index
        assert scanned(files.filter("doc_id = 5001")) == 0  # between the ids of a row group: by the Bloom filter
        assert scanned(files.filter("doc_id > 16000")) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_start_follows_split_numbers(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a " * i) for i in range(6)], "doc_id long, text string")
    token_files.write(docs.coalesce(1), f"file://{tmp_path}/ids")
    rename = {99999: "part-99999", 100000: "part-100000"}
    files = sorted((tmp_path / "ids").glob("part-*.orc"))
    for n, f in zip(rename, files[-2:], strict=True):  # names of splits beyond five digits sort otherwise
        f.rename(f.with_name(f.name.replace(f.name[:10], rename[n])))
        crc_file = f.with_name(f".{f.name}.crc")
        crc_file.unlink(missing_ok=True)
    got = token_files.digests(spark, f"file://{tmp_path}/ids", f"file://{tmp_path}/work").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(6)) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_packing(docs, empty):
    ids = direct([r[1] or "" for r in rows()])
    want = [(r[0], k, s, n, crc(x[s : s + n])) for r, x in zip(rows(), ids, strict=True) for k, (s, n) in enumerate(packing.cut(len(x)))]
    got = packing.pack_documents(docs).collect()
    assert by_none([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]) == by_none(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1].tolist()] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(x[3] for x in want) // 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_lm_scoring(docs, empty, monkeypatch):
    w3 = np.tile([0.5, 0.3, 0.2], (lm_scoring.BUCKETS, 1))
    monkeypatch.setattr(lm_scoring, "learn", lambda cells: w3)
    toks = [(r[0], re.findall(WORD, (r[1] or "").translate({c: c + 32 for c in range(65, 91)})) + ["</s>"]) for r in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, cv = Counter(), Counter()
    for i, t in toks:
        if not held(i):
            c.update(t)
            cv.update(zip(["</s>", *t[:-1]], t, strict=True))
    N, V = sum(c.values()), len(c)
    want = []
    for i, t in toks:
        p = sum(log10(0.5 * (cv[a, b] / c[a] if c[a] else 0) + 0.3 * c[b] / N + 0.2 / (V + 1)) for a, b in zip(["</s>", *t[:-1]], t, strict=True))
        want.append((i, held(i), len(t), sum(c[x] > 0 for x in t), N, round(sum(log10((c[x] + 1) / (N + V + 1)) for x in t), 4), round(p, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lm_scoring.score(docs).collect()]
    assert by_none(got) == by_none(want)
    assert lm_scoring.score(empty).count() == 0


def test_expectation_maximisation_finds_weights():
    import pandas as pd

    w = lm_scoring.learn(pd.DataFrame({"cell": [5 * lm_scoring.BINS**2, 5 * lm_scoring.BINS**2 + 1], "n": [60, 40], "r2": [60 * 100.0, 0.0], "r1": [60.0, 40 * 100.0]}))
    assert w[5].sum() == pytest.approx(1) and w[5][0] == pytest.approx(0.6, abs=0.03)


def test_language_id(spark, docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert {(40, "und"), (41, "und"), (42, "und")} <= got
    assert language_id.identify(empty).count() == 0
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.95


def test_viterbi_equals_all_segmentations():
    rng = random.Random(5)
    for _ in range(200):
        pieces = [(p, -rng.random() * 5, i) for i, p in enumerate({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 3))) for _ in range(6)})]
        v = sentence_pieces.Pieces(pieces, {}, 99)
        s = "".join(rng.choice("abcd▁") for _ in range(rng.randint(1, 9)))
        best = [0.0] + [-1e18] * len(s)
        for e in range(1, len(s) + 1):
            for p, score, _ in pieces:
                if s[:e].endswith(p):
                    best[e] = max(best[e], best[e - len(p)] + score)
            if s[e - 1] not in v.single:
                best[e] = max(best[e], best[e - 1] + v.lost)
        assert v.viterbi(s)[1] == pytest.approx(best[-1])


def test_sentence_pieces_round_trip(docs, empty):
    out = sentence_pieces.encode(docs)
    for r in out.collect():
        assert r.round_trip or r.doc_id == 45
        assert r.n_pieces == len(r.ids)
    import public_tokenizers

    back = {(r.doc_id, r.text) for r in sentence_pieces.decode(out, vocabulary=public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert {(r[0], r[1] or "") for r in rows() if r[0] != 45} <= back
    assert sentence_pieces.encode(empty).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    rng = random.Random(9)
    texts = [r[1] or "" for r in rows()] + ["a \x1cb", " x", "x ", "it's  we'll\n\n don't", "<|endoftext|> a", "日本 語 1a ²", "a.\nB c\n d", "\n a", " ", "  ", "a\xa0b \xa0c", "x\u2028y z", "é\xadª1½$$ µ'à"]
    texts += ["".join(rng.choice("ab é1½.$'\n\t \x85\xa0日<|endoftext|>") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(["a", " ", "\n", "éa", "12", "$", "'s", "<|endoftext|>", "ſ", "٣", "\u3000"]) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    for cache in (50, bpe.CACHE):
        e = bpe.Encoder(bpe.vocabulary(), cache=cache)
        want = [np.array(x, "<u4").tobytes() for x in direct(texts)]
        for chunk in (bpe.CHUNK, 16):
            monkeypatch.setattr(bpe, "CHUNK", chunk)
            ids, bound = e.many([t.encode() for t in texts], np.array([0], "<u4").tobytes())
            assert [ids[a:z].tobytes() for a, z in zip(bound[:-1], bound[1:], strict=True)] == want
        monkeypatch.undo()
        assert e(texts[3]) == want[3][:-4]


def test_pipeline_drops_texts_in_no_learned_language(spark):
    import corpus_pipeline

    rng = random.Random(1)
    odd = {
        -1: "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 5,
        -2: "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью " * 5,
        -3: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)),
        -4: " ".join(f"{rng.getrandbits(32):08x}" for _ in range(80)),
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").filter("size(split(text, ' ')) >= 50")
    more = spark.createDataFrame([(i, t, None, "web", len(t)) for i, t in odd.items()], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


def test_language_id_scores_any_number_of_languages_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    whole = {r.doc_id: r for r in language_id.identify(docs).collect()}
    langs, blocks, prior = language_id.train(docs)
    texts = [r.text.encode() for r in docs.filter("text is not null").limit(40).collect()]
    alone = language_id.best_of(texts, map(language_id.matrix, blocks), prior)
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    blocks = language_id.train(docs)[1]
    assert len(langs) == 4 and [len(b[0]) for b in blocks] == [2, 2]
    for a, b in zip(alone, language_id.best_of(texts, map(language_id.matrix, blocks), prior), strict=True):
        assert a == pytest.approx(b)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: r.lang_pred for i, r in whole.items()}
    monkeypatch.undo()
    dirty = docs.withColumn("lang", F.concat("lang", F.pmod(F.col("doc_id"), F.lit(75)).cast("string")))
    assert len(language_id.train(dirty)[0]) > language_id.MAX_LANGS or dirty.select("lang").distinct().count() <= language_id.MAX_LANGS
