"""The corpus pipeline: quality rules, language ID, near-duplicates, repeated passages, packing.

Every stage but the last returns rows of its input, with all of its columns, whatever these are named, and judges rows, not
ids: rows are told apart by a key of their own, so that null and repeated doc_ids are rows like any others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, language_id, near_dups, packing, quality_rules, substring_dedup


def _unused(docs: DataFrame, name: str) -> str:
    """name, or the same after as many underscores as make it differ from all columns' beginnings."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def _only(rows: DataFrame, row: str, good: DataFrame) -> DataFrame:
    """The rows whose key is in good's first column, without the key."""
    return rows.join(good.select(F.col(f"`{good.columns[0]}`").alias(row)), row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality rules keep.

    Null and empty texts have under 50 words and go. Equal rows share one fate. Null languages and sources are groups of
    their own. An empty table stays empty.
    """
    row = _unused(docs, "row")
    rows = common.row_key(docs, row)
    judged = quality_rules.judge(rows, id_col=row)
    return _only(rows, row, judged.filter("kept").select("doc_id"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without a letter, and those whose n-grams are far less likely than those of the training documents of the
    language found (the posterior is near 1 for any long text).

    Null and empty texts go. A null doc_id is not held out; a null language is not learned from. Equal rows share one fate.
    Without any labelled row all rows go, since no language is known. An empty table stays empty.
    """
    known = docs.filter(~language_id.held_out() & F.col("lang").isNotNull())
    model = language_id.train(known)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("document"))
    found = language_id.predict(plain, model, keep=tuple(plain.columns[:-1]), text_col="document", with_fit=True)
    good = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("fit") >= language_id.least_fit(known, model)))
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked texts: that with the smallest doc_id (null last), of several such the one with
    the least digest of its text, which is the same whatever the order of rows.

    Null, empty and blank texts are linked with nothing and stay. Rows with unrelated texts stay although they share an id.
    An empty table stays empty.
    """
    row = _unused(docs, "row")
    rows = common.row_key(docs, row)
    found = near_dups.resolve(rows, id_col=row).select(F.col("doc_id").alias("row_key"), "component_id")
    order = rows.select(F.col(row).alias("row_key"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row)).alias("place"))
    first = found.join(order, "row_key").groupBy("component_id").agg(F.min_by("row_key", "place").alias("row_key"))
    return _only(rows, row, first.select("row_key"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts; a text that has none stays as it is, and so does the white space between
    kept words of one that has. n_chars, if there is one, becomes the new length.

    Null and empty texts stay. Rows with a null doc_id lose nothing; rows that share a doc_id aren't each other's copies. An
    empty table stays empty.
    """
    row = _unused(docs, "row")
    rows = common.row_key(docs, row)
    cut = substring_dedup.remove_repeats(rows, row_col=row, with_text=True).filter("n_removed > 0").select(F.col("row").alias(row), F.col("kept").alias(f"{row}_text"))
    new = F.col(f"{row}_text")
    put = {"text": F.coalesce(new, F.col("text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(new.isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return rows.join(cut, row, "left").select(*[put.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Null and empty texts are one piece with the end id alone. Null and repeated ids and equal rows are packed row by row.
    An empty table gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("language_id", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]
#: Classifier, estimates and packing aren't SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage leaves in shared folders goes once
    the next one is written."""
    path = common.staging(spark)

    def step(docs: DataFrame, k: int) -> DataFrame:
        with common.scratch(spark):
            out = common.saved(STAGES[k][1](spark, docs, sf_dir), f"{path}/{k}")
        if k:
            common.drop(spark, f"{path}/{k - 1}")
        common.release(spark)
        return out

    return reduce(step, range(len(STAGES)), spark.read.parquet(f"{sf_dir}/documents.parquet"))
