"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import ann, importance, language_id, license_scan, lm_scoring, near_dups, packing, periodic_runs, pii, quality_rules, sentence_pieces, substring_dedup, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_digest(_documents(spark, sf_dir))


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.resolve(_documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(_documents(spark, sf_dir), with_ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(_documents(spark, sf_dir), plant=True))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_substring_dedup, op2_license_scan, op3_nearest_neighbours, op4_quality_rules, op5_token_files, op6_minhash_near_dups, op7_lm_scoring,
        op8_language_id, op9_best_fit_packing, op10_sentence_pieces, op11_periodic_runs, op12_importance_resampling, op13_personal_data,
    )
    return {f.__name__: f for f in ops}


#: Every window of 50 words with the smallest id among the documents in which it starts.
_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM pos),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN low USING (h) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS x FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t, count(*) AS n FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.k = hit.k WHERE hit.k IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

#: Exact similarities of all pairs that share a shingle, and the smallest id that links reach.
_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * met >= 75 * (x.n + y.n - met)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON w.doc_id = c.doc_id LEFT JOIN n ON w.doc_id = n.doc_id"""

#: CRC-32 bit by bit over the bytes of a list x: the register starts as ones and ends inverted.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], {x}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT)"
_BYTES = "list_transform(range(1, octet_length(encode({w})) + 1), lambda i: ('0x' || substr(hex(encode({w})), 2 * i - 1, 2))::UBIGINT)"
#: Words after the planted repetitions; stretches in which windows of three words are the same q words earlier, q with them.
_OP11 = r"""
WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {crc}::BIGINT AS h FROM (SELECT *, doc_id::VARCHAR AS id FROM documents)),
w1 AS (SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a FROM w0), w2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM w1),
w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM w2),
t AS (SELECT doc_id, n, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS g FROM (SELECT *, unnest(range(n - 2)) AS i FROM w)),
m AS (SELECT a.doc_id, b.i - a.i AS q, b.i AS j FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
z AS (SELECT doc_id, q, min(j) - q AS s, max(j) + 3 AS e FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS run FROM m) GROUP BY doc_id, q, run),
r AS MATERIALIZED (SELECT doc_id, s, e - s AS length, min(q) AS period, e FROM z WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
d AS (SELECT DISTINCT doc_id, unnest(range(s + period, e)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS word FROM w) x LEFT JOIN d ON d.doc_id = x.doc_id AND d.i = x.i WHERE d.i IS NULL GROUP BY x.doc_id),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || period || chr(10), '' ORDER BY s, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, s, period) = 1)
SELECT w.doc_id, coalesce(o.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id""".replace("{crc}", _CRC.format(x=_BYTES.format(w="id")))
#: Counts by bucket of all words of both tables, gains, weights, noise, and the order of the documents long enough.
_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(words) AS w FROM d),
v AS MATERIALIZED (SELECT w, {crc} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM q)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM q JOIN v USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT d.doc_id, len(d.words)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
FROM d LEFT JOIN (SELECT doc_id, sum(gain) AS weight FROM f JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id) m ON m.doc_id = d.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= floor(n / 10) THEN nth END AS rank FROM r""".replace("{crc}", _CRC.format(x=_BYTES.format(w="w")))


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op2_license_scan": license_scan.oracle(), "op6_minhash_near_dups": _OP6, "op11_periodic_runs": _OP11, "op12_importance_resampling": _OP12}
