"""Periodic runs, importance resampling and personal data against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import importance, periodic_runs, pii
from tidewatch.llm import text as T

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every maximal stretch with its smallest period, by definition."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def search(w):
    text = " ".join(w).encode()
    (ranges,) = periodic_runs.suspects(T.words([text]))
    return periodic_runs.runs(text.split(), ranges) if ranges else []


def test_runs_equal_definition():
    rng = random.Random(5)
    cases = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, list("abab" * 3), list("abcabcabcabcab"), list("xaaaaaay"), list("aabaabaabaabab")]
    for _ in range(400):
        w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            block = [rng.choice("abcdefg") for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(w))
            w[at:at] = (block * rng.randint(3, 7))[: rng.randint(1, 60)]
        cases.append(w)
    for w in cases:
        want = plain_runs(w)
        assert periodic_runs.runs(w) == want, w
        assert search(w) == want, w


def test_long_runs_and_ordered_sets(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(periodic_runs, "PIECE", 8)
    kept, order = periodic_runs.Ordered(500), list(range(500)) + list(range(501, 900))
    rng.shuffle(order)
    seen = [500]
    for x in order:
        want = (max((y for y in seen if y < x), default=None), min((y for y in seen if y > x), default=None))
        assert kept.add(x) == want
        seen.append(x)
    assert list(kept) == sorted(seen) and kept.size == len(seen)
    block = [f"w{rng.randint(0, 10**6)}" for _ in range(997)]
    assert search(["x", *block * 21, "y"]) == [(1, 997 * 21, 997)]
    assert search(["z"] * 100_000) == [(0, 100_000, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (3, "a b a b a b a b c  d\n\n\te", "x"), (3, "a b a b a b a b c  d\n\n\te", "x"), (None, "same " * 40, "x"), (9, None, None), (10, "", "x"), (11, "  \n ", "x"), (12, "one two é é é é é é", "x"),
        *[(i, " ".join(f"w{(i * j) % 97}" for j in range(200)), "y") for i in range(20, 220)], (500, "q " * 30_000 + "end", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)


def test_periodic_runs_query(docs):
    def expected(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = [(0, 30_000, 1)] if i == 500 and h % 10 else plain_runs(w)
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        text = " ".join(x for k, x in enumerate(w) if k not in drop)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (i, len(runs), *((None,) * 4 if top is None else (top[0], top[1], top[2], 1000 * top[1] // top[2])), sha(lines), sha(text))

    got = sorted(map(tuple, periodic_runs.digest(periodic_runs.find(docs, plant=True)).collect()), key=str)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(r[1] for r in got) > 15
    assert periodic_runs.find(docs.limit(0), plant=True).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find(docs, times=2)


def grams(t, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 2])
def test_importance_resampling(spark, docs, longest):
    target = spark.createDataFrame([("W3 w5, É w7 W7",), ("w3 a",), (None,), ("",)], "text string")
    bucket = lambda f: zlib.crc32(f.encode()) % 300
    rows = [(r["doc_id"], *grams(r["text"], longest)) for r in docs.collect()]
    s, t = Counter(bucket(f) for _, _, fs in rows for f in fs), Counter(bucket(f) for r in target.collect() for f in grams(r[0], longest)[1])
    S, N = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 300) / ((s[b] + 1) * (N + 300))))
    noise = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    want = [[i, len(fs), sum(gain(bucket(f)) for f in fs), len(w)] for i, w, fs in rows]
    for r in want:
        r.insert(3, r[2] + noise(r[0]))
    fit = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    most = len(fit) * 10 // 100
    for k, r in enumerate(fit):
        r[4] = k + 1 if k < most else None
    for r in want:
        if r[1] == 0 or r not in fit:
            r[4] = None
    got = importance.score(docs, target, buckets=300, longest=longest)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    drawn = importance.draw(docs, target, buckets=300, longest=longest)
    assert drawn.columns == docs.columns
    assert sorted((r["doc_id"] for r in drawn.collect()), key=str) == sorted((r[0] for r in fit[:most]), key=str)
    assert importance.score(docs.limit(0), target).count() == 0
    assert importance.score(docs, target.limit(0)).filter("rank is not null").count() == most


def test_checksums_of_spans():
    texts = [b"ab " + b"x" * 64 + b" " + b"y" * 65 + b" " + b"z" * 5000, None, "é ü".encode(), b"", b"a b c"]
    for longest in (1, 2, 3):
        stream, n, words = importance.features(texts, 1 << 16, longest)
        at = 0
        for t, k, w in zip(texts, n, words, strict=True):
            own, fs = grams((t or b"").decode(), longest)
            assert len(own) == w and sorted(stream[at : at + k]) == sorted(zlib.crc32(f.encode()) % (1 << 16) for f in fs)
            at += k
    with pytest.raises(ValueError):
        importance.streams(None, (1 << 16) + 1, 1, id_col=None)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    n = [int(c) for c in d[::-1]]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


def plain_base(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d(m.group())) <= 19 and plain_luhn(d(m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(d(m.group())) <= 15])


def luhn_number(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if plain_luhn(body + c))


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    texts = ["", "a@b", "a@b.c", "a@b.c@d.e", ".@a.b.", "a@b..c", "é@x.y", "x@é.y a.b@c.d.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0001.2.3.4", "+1", "+12", "+1 2", "+1 2345678)", "+1 (830) 555-5433 4785380592391139", "1-1-1", "4" * 5000, "1 " * 3000, "@" * 300, "a" * 3000 + "@", "١٢٣@x.y"]
    for _ in range(3000):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts.append(rng.choice(["@", ".", "+", "-", " ", "(", ")", "a", "%b", "c.d", "é", "7", "255.", "1.2.3.4", luhn_number(rng, rng.randint(11, 20)), "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.zz", "tel", "account ", "://", "(at)", "IBAN ", "²", "٣"]))
        texts.append("".join(parts))
    for t in texts:
        assert sorted(pii.Parsers(t).run().base) == plain_base(t), t


@pytest.mark.parametrize(
    "text, added",
    [
        ("call +1 (830) 555-5433 4785380592391139 now", [("phone", "+1 (830) 555-5433"), ("card", "4785380592391139")]),
        ("5555 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ("1234 378282246310005 99", [("card", "378282246310005")]),
        ("mail jürgen.müller@example.com or x", [("email", "jürgen.müller@example.com")]),
        ("mail info@bücher.example, please", [("email", "info@bücher.example")]),
        ("write jane.doe (at) example (dot) com!", [("email", "jane.doe (at) example (dot) com")]),
        ("jane[at]mail.example.org", [("email", "jane[at]mail.example.org")]),
        ("ftp://joe:secret@build1/x", [("email", "joe:secret@build1")]),
        ("Phone: 030 1234567.", [("phone", "030 1234567")]),
        ("hotel 1234567", []),
        ("Account no. 12345678", [("account", "12345678")]),
        ("IBAN: DE89 3704 0044 0532 0130 00, thanks", [("account", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("version 1.2.3, page 12 of 200, 3 + 4, at noon, e-mail", []),
        ("300.1.2.3", []),
    ],
)
def test_added_spans(text, added):
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans_of(text) if not s["base"]] == sorted(added, key=lambda a: text.index(a[1]))


def test_personal_data_query(spark):
    long = "x" * 200_000 + " a@b.cc " + "9" * 100_000
    rows = [(1, "é a.b@c.de und 10.0.0.1", 5), (1, "é a.b@c.de und 10.0.0.1", 5), (None, "+1 (830) 555-5433", 5), (3, None, 5), (4, "", 5), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(0).cast("long").alias("spans")))
    got = pii.digest(pii.find(docs)).collect()
    want = []
    for r in docs.collect():
        base = plain_base(r["text"] or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((r["doc_id"], *[sum(x[1] == k for x in base) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        at = [(int(s), pii.KINDS.index(k)) for k, s, _ in (x.split(":") for x in r["spans"].split(",") if x)]
        assert at == sorted(at) and len(at) >= sum(tuple(r)[1:5])
    kept = {r["doc_id"]: r["text"] for r in pii.redact(docs.limit(6)).collect()}
    assert kept[1] == "é [EMAIL] und [IP]" and kept[None] == "[PHONE]" and kept[3] is None and kept[4] == ""
    assert pii.find(docs.limit(0)).count() == 0
