"""Learned verdicts against plain recomputation, and the pipeline's stages against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_llm import by_none, crc, direct, key
from tidewatch.llm import blocks as B
from tidewatch.llm import common, language_id, near_dups, packing, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUALITY = "doc_id long, text string, lang string, source string, row long, own string, pool string, distance int"


def quality_docs(spark):
    rng = random.Random(4)
    out = []
    for i in range(400):
        lang, source = ("aa", "s0") if i % 3 else (["aa", "bb", None][i % 9 // 3], f"s{i % 7}")
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6 + 2 * (lang == "bb")))) for _ in range(rng.randint(0, 160))]
        if i % 10 == 0:
            words = [w + rng.choice(["%%", "#", ""]) for w in words]
        if i % 17 == 0:
            words = words[:20] * 4
        text = " ".join(words[:70]) + "\n" + "\n".join([" ".join(words[70:90])] * (1 + 3 * (i % 23 == 0)))
        out.append((i, text, lang, source, 1, "o", "p", 2))
    out += [(500, None, "aa", "s0", 1, "o", "p", 2), (501, "", None, None, 1, "o", "p", 2), (7, out[7][1], "cc", "s9", 1, "o", "p", 2)]
    return spark.createDataFrame(out, QUALITY)


def middle(v):
    """percentile_approx of 0.5: the least value with half of the rows at or below it."""
    return np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]


def plain_mcd(x):
    """Mean, covariance times scale, by the same two starts and steps as the operator, on one group's vectors."""
    d, floor = x.shape[1], np.array(quality_rules.FLOORS)
    m = middle(x)
    sd = middle(np.abs(x - m)) * 1.4826
    starts = [(m, np.diag(sd**2 + floor**2), 0.0)]
    far = (x - m) / floor
    signs = far / np.sqrt((far**2).sum(1) + 1e-12)[:, None] * floor + m
    cov = np.cov(signs.T, bias=True) + np.diag(floor**2)
    starts.append((signs.mean(0), cov, np.linalg.slogdet(cov)[1]))
    distance = lambda mu, cov: np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)
    found = []
    for s, (mu, cov, logdet) in enumerate(starts):
        for _ in range(quality_rules.STEPS):
            dist = distance(mu, cov)
            h = x[dist <= middle(dist) * (1 + 1e-12) + 1e-15]
            mu, cov = h.mean(0), np.cov(h.T, bias=True).reshape(d, d) + np.diag(floor**2)
            logdet = np.linalg.slogdet(cov)[1]
        found.append((round(logdet, 9), s, mu, cov))
    _, _, mu, cov = min(found, key=lambda f: f[:2])
    return mu, cov * max(1.0, middle(distance(mu, cov)) / quality_rules.chi2_quantile(0.5, d))


def test_quality_verdicts_equal_plain_estimates(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "STEPS", 3)
    monkeypatch.setitem(quality_rules.judge.__kwdefaults__, "steps", 3)
    docs = quality_docs(spark)
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    stats = [quality_rules.count_stats([(r.text or "").encode()]) for r in rows]
    s = {c: np.array([x[c][0] for x in stats], float) for c in quality_rules.STAT_NAMES}
    n1 = s["n_words"] + 1
    x = np.stack([np.log((s["word_chars"] + 1) / n1), np.sqrt(s["n_symbols"] / (s["word_chars"] + 1)), np.sqrt(s["n_dup_lines"] / (s["n_lines"] + 4)), np.sqrt(s["n_repeat_words"] / n1) / np.log10(s["n_words"] + 10) * 2], 1)
    groups = {}
    for i, r in enumerate(rows):
        for g in ((r.lang, r.source), (r.lang,), ()):
            groups.setdefault(g, []).append(i)
    est = {g: plain_mcd(x[i]) for g, i in groups.items()}

    def mix(g, wider):
        (m1, c1), (m2, c2), w = est[g], wider, len(groups[g]) / (len(groups[g]) + quality_rules.SHRINK)
        return w * m1 + (1 - w) * m2, w * c1 + (1 - w) * c2 + w * (1 - w) * np.outer(m1 - m2, m1 - m2)

    limit = quality_rules.chi2_quantile(1 - quality_rules.REJECT, 4)
    want = []
    for i, r in enumerate(rows):
        mu, cov = mix((r.lang, r.source), mix((r.lang,), est[()]))
        d = (x[i] - mu) @ np.linalg.inv(cov) @ (x[i] - mu)
        failed = s["n_words"][i] < 50 or 100 * s["n_repeat_words"][i] > 50 * s["n_words"][i]
        want.append((r.doc_id, int(s["n_words"][i]), not failed and d <= limit, d))
    assert {w[2] for w in want} == {True, False}
    for few in (quality_rules.FEW_GROUPS, 0):  # 0: rows and estimates meet by group and salt
        monkeypatch.setattr(quality_rules, "FEW_GROUPS", few)
        got = key(quality_rules.judge(docs), "doc_id", "n_words", "kept", "distance")
        for a, b in zip(got, by_none(want), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-6, abs=1e-9)


def test_every_group_has_an_estimate(spark):
    one = spark.createDataFrame([(1, "word " * 3, "aa", "s", 1, "o", "p", 2)], QUALITY)
    (r,) = quality_rules.judge(one).collect()
    assert r.base_failed and not r.kept and r.distance is not None


def mixed(x):
    """The splitmix64 finaliser in plain integers."""
    m = 2**64 - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def plain_grams(text):
    codes = [32, *(max(ord(c), 32) for c in text.lower()), 32]
    out = Counter()
    for order in language_id.ORDERS:
        for i in range(len(codes) - order + 1):
            acc = order
            for c in codes[i : i + order]:
                acc = ((acc << 20) & (2**64 - 1)) ^ (acc >> 44) ^ c
            out[mixed(acc) >> (64 - language_id.BITS)] += 1
    return out


def test_language_scores_equal_plain_naive_bayes(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "éèàbcö", None: "abcxyz"}
    rows = []
    for i in range(60):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))), lang))
    rows += [(60, None, "aa"), (61, "", "bb"), (62, "12 $", None), (63, "ab " * 30000, "aa"), (None, "dé\tf\x01g", "cc"), (3, "ab", "bb"), (3, "ab", "bb")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    count, docs = {}, Counter()
    for i, t, lang in rows:
        if not held(i) and t is not None and lang is not None:
            count.setdefault(lang, Counter()).update(plain_grams(t))
            docs[lang] += 1
    want = []
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            want.append((i, held(i), "und", 0.0))
            continue
        like = {}
        for lang in sorted(count):
            total = sum(count[lang].values()) + 0.5 * language_id.BUCKETS
            like[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((count[lang][b] + 0.5) / total) for b, n in plain_grams(t).items())
        best = max(like, key=like.get)
        want.append((i, held(i), best, 1 / sum(math.exp(x - like[best]) for x in like.values())))
    got = key(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "doc_id", "held_out", "lang_pred", "score")
    for a, b in zip(got, by_none(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-12)


def pipeline_docs(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base, out = text(70), text(120).split(), []
    for i in range(60):
        t = text(rng.randint(40, 140))
        if i % 6 == 0:
            t = text(60) + "\n" + passage + "\n" + text(30)
        if i % 9 == 4:
            w = base[:]
            w[rng.randrange(len(w))] = "x"
            t = " ".join(w)
        out.append((i, t, ["aa", "bb", None][i % 3]))
    out += [(None, text(80), "aa"), (None, out[4][1], "aa"), (5, text(90), "aa"), (5, out[13][1], "aa"), (9, out[9][1], "aa"), (70, None, "aa"), (71, "", "aa"), (72, "1 " * 60, "aa"), (73, "жщ " + " ".join("жщюя" for _ in range(70)), "bb"), (74, text(20000), "aa")]
    extra = "kept_id long, kept boolean, score double, row long, n long, words string, row_file string, c0 string, lang_pred string, n_removed int, component_id long"
    return spark.createDataFrame([(i, t, lang, "web", len(t or ""), 1, True, 0.5, 2, 3, "w", "f", "c", "l", 4, 5) for i, t, lang in out], f"doc_id long, text string, lang string, source string, n_chars int, {extra}")


def rows_of(df):
    return by_none([tuple(r) for r in df.collect()])


def test_pipeline_stages_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(quality_rules.judge.__kwdefaults__, "steps", 1)
    docs = pipeline_docs(spark).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages, at = dict(corpus_pipeline.STAGES), 0

    def step(name, docs):
        nonlocal at
        at += 1
        stages[name](spark, docs, "").write.parquet(f"{tmp_path}/{at}")
        return spark.read.parquet(f"{tmp_path}/{at}")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for source in (docs, docs.unionByName(docs.limit(0))):  # of files, and of no files: another way to tell rows apart
        out = step("quality_rules", source)
        ids = source.withColumn("at", common.F.monotonically_increasing_id()).cache()
        good = quality_rules.judge(ids, id_col="at").filter("kept").select(common.F.col("doc_id").alias("at"))
        assert rows_of(out) == rows_of(ids.join(good, "at").select(*docs.columns)) and out.columns == docs.columns
    assert 0 < out.count() < docs.count()

    docs, seen = out, out.collect()
    out = step("language_id", docs)
    kept = out.collect()
    assert not [r for r in kept if r.text.startswith("1 ")] and {r.doc_id for r in seen} - {r.doc_id for r in kept} <= {72, 73}
    assert out.columns == docs.columns

    docs, rows = out, kept
    sets = []
    for r in rows:
        w = WORD.findall(r.text.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= near_dups.SIMILAR * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    out = step("near_duplicates", docs)
    kept = out.collect()
    assert len(kept) == len(groups) < len(rows)
    for g in groups.values():
        (one,) = [r for r in kept if tuple(r) in {tuple(x) for x in g}]
        assert (one.doc_id is None, one.doc_id) == min((x.doc_id is None, x.doc_id or 0) for x in g) or one.doc_id is None

    docs, rows, low = out, kept, {}
    split = [(r, WORD.findall(r.text)) for r in rows]
    for r, w in split:
        for k in range(len(w) - 49):
            if r.doc_id is not None:
                g = tuple(w[k : k + 50])
                low[g] = min(low.get(g, r.doc_id), r.doc_id)
    out = step("repeated_passages", docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_chars) for r in out.collect())
    want, changed = [], 0
    for r, w in split:
        gone = {k + j for k in range(len(w) - 49) if r.doc_id is not None and low[tuple(w[k : k + 50])] < r.doc_id for j in range(50)}
        changed += bool(gone)
        want.append((r.doc_id is None, r.doc_id or 0, r.text if not gone else [x for k, x in enumerate(w) if k not in gone], r.n_chars))
    assert changed > 2
    want = sorted(want, key=lambda x: (x[0], x[1], " ".join(WORD.findall(x[2])) if isinstance(x[2], str) else " ".join(x[2])))
    got = sorted(got, key=lambda x: (x[0], x[1], " ".join(WORD.findall(x[2]))))
    for a, b in zip(got, want, strict=True):
        if isinstance(b[2], str):
            assert a == b
        else:
            assert a[:2] == b[:2] and WORD.findall(a[2]) == b[2] and a[3] == len(a[2]) and a[2].count("\n") <= 2

    docs, rows = out, out.collect()
    ids = direct([r.text or "" for r in rows])
    cut = [(r.doc_id, k, s, n, crc(x[s : s + n])) for r, x in zip(rows, ids, strict=True) for k, (s, n) in enumerate(packing.cut(len(x)))]
    out = step("packing", docs)
    assert key(out, "doc_id", "piece", "start", "length", "ids_crc32") == by_none(cut)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert key(whole, "doc_id", "piece", "start", "length", "ids_crc32") == by_none(cut)


def test_pipeline_of_an_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(quality_rules.judge.__kwdefaults__, "steps", 1)
    pipeline_docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_row_keys_are_unique_and_steady(spark, tmp_path):
    pipeline_docs(spark).repartition(5).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for df in (docs, docs.unionByName(docs)):
        keyed = common.row_key(df, "number")
        once = {r.number: hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in keyed.collect()}
        assert len(once) == df.count()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        try:
            assert once == {r.number: hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in keyed.select("*").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stage_tables_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf  # noqa: N815

    class Session:
        conf, sparkContext = spark.conf, Context()  # noqa: N815

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            common.staging(Session())


def test_workers_give_memory_back(spark, monkeypatch):
    """A reused worker keeps what a plain task has freed below something live, but not after a spared one; and the stages'
    tasks are spared."""
    common.ship(spark)
    rows = spark.range(2, numPartitions=1)
    size = "kb long"

    def work(batches):
        live = [bytearray(64 << 10) for _ in range(2 * 1600)]
        kept.extend(live[1::2])
        del live
        for b in batches:
            yield pa.RecordBatch.from_pydict({"kb": [0] * b.num_rows})

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"kb": [int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read()).group(1))]})

    def both(batches):
        start = next(look([0]))["kb"][0].as_py()
        list(run(batches))
        yield pa.RecordBatch.from_pydict({"kb": [next(look([0]))["kb"][0].as_py() - start]})

    kept: list = []
    run = work
    plain = rows.mapInArrow(both, size).first().kb
    run = common.spared(work)
    spared = rows.mapInArrow(both, size).first().kb
    assert plain > 180_000 and spared < 150_000, (plain, spared)
    seen = []
    monkeypatch.setattr(common, "spared", lambda f: seen.append(f.__qualname__) or f)
    docs = spark.createDataFrame([(i, f"some words {i}", "aa", "s") for i in range(4)], "doc_id long, text string, lang string, source string")
    quality_rules.base_stats(docs)
    language_id.predict(docs, language_id.train(docs))
    near_dups._signed(docs.select("doc_id", "text"))
    packing.pieces_of(docs)
    substring_dedup._prefixes(B.write(docs, f"{common.staging(spark)}/blocks"), 4)
    assert len(seen) == 7, seen
