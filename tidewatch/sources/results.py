"""Where scores and metrics are written to and read back from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.sources.files import write_files

METRICS = """
pointwise struct<precision:double, recall:double, f1:double, tp:double, fp:double, fn:double>,
event_level struct<precision:double, recall:double, f1:double, tp:long, fp:long, fn:long, n_true_events:long, n_pred_events:long>,
business struct<fp_per_day:double, median_latency_minutes:double, fp_count:long, duration_days:double>,
fp_per_day double, median_latency_minutes double, best_k double, val_f1 double, best_threshold double"""


def path_key(name):
    """A series' name as one folder."""
    return F.regexp_replace(name, "/", "__")


def write_scores(scores: DataFrame, path: str, form: str = "parquet") -> None:
    """Partitioned by model and series, so that one run's scores are read alone."""
    scores.withColumn("series_id", path_key("series_id")).write.mode("overwrite").partitionBy("model", "series_id").option("header", True).format(form).save(path)


def read_scores(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """What write_scores wrote: scores, predictions or decompositions, with their model and series_id."""
    return spark.read.option("header", True).option("inferSchema", form == "csv").format(form).load(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(model, series_id, parts of METRICS): one <model>/<series>/metrics.json for each row below path; null parts stay out,
    and what isn't a number is bare, as in Python's own files. Files of other runs stay."""
    parts = F.to_json(F.struct(*[F.col(f"`{c}`") for c in metrics.columns if c not in ("model", "series_id")]))
    bare = F.regexp_replace(parts, r':"(NaN|Infinity|-Infinity)"', ":$1")
    write_files(metrics.select(_file("metrics.json").alias("path"), bare.alias("content")), path)


def _file(name: str):
    return F.concat_ws("/", path_key("model"), path_key("series_id"), F.lit(name))


def write_predictions(rows: DataFrame, path: str, name: str = "predictions.csv") -> None:
    """(model, series_id, idx, further columns): one <model>/<series>/<name> for each series, its rows by idx; nulls are
    empty. A series' file is written by one task, row by row."""
    columns = [c for c in rows.columns if c not in ("model", "series_id", "idx")]
    lines = rows.select(_file(name).alias("path"), "idx", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns]), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("content"))
    write_files(lines.repartition("path").sortWithinPartitions("path", "idx").select("path", "content"), path, ",".join(columns))


def write_plots(plots: DataFrame, path: str, name: str) -> None:
    """(model, series_id, svg): one <model>/<series>/<name> for each row."""
    write_files(plots.select(_file(name).alias("path"), F.col("svg").alias("content")), path)


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Every metrics.json below path: model from the folder above the series' folder, in capitals. Bare NaN is read; an
    event_level that is null in the file drops the run, one that is missing doesn't."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    read = raw.select(F.upper(F.element_at(parts, -3)).alias("Model"), F.element_at(parts, -2).alias("Dataset"), "value", F.from_json("value", METRICS).alias("m"))
    null_events = F.coalesce(F.col("value").rlike(r'"event_level"\s*:\s*null'), F.lit(False))
    return read.filter(~null_events).select("Model", "Dataset", "m.*")


def scan_folds(spark: SparkSession, path: str) -> DataFrame:
    """Every cv_results.json below path, an array of folds: Model from the folder, then f1, fp_per_day, latency of each fold."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "cv_results.json").text(path, wholetext=True)
    folds = F.from_json("value", "array<struct<f1:double, fp_per_day:double, latency:double>>")
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("Model"), F.posexplode(folds).alias("fold", "x")).select("Model", "fold", "x.*")


def first_runs(metrics: DataFrame) -> DataFrame:
    """One run of each model: the first by its data set's name."""
    order = F.row_number().over(Window.partitionBy("Model").orderBy("Dataset"))
    return metrics.withColumn("nth", order).filter("nth = 1").drop("nth")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Flat rows, best event F1 first. Without business metrics the flat fields count; missing counts are 0."""
    has = F.col("business").isNotNull()
    level = lambda name: F.when(F.col("event_level").isNotNull(), F.coalesce(F.col(f"event_level.{name}"), F.lit(0.0)))
    return metrics.select(
        "Model",
        "Dataset",
        level("f1").alias("Event_F1"),
        level("precision").alias("Precision"),
        level("recall").alias("Recall"),
        F.when(has, F.coalesce("business.fp_per_day", F.lit(0.0))).otherwise(F.col("fp_per_day")).alias("FP_per_Day"),
        F.when(has, F.coalesce("business.median_latency_minutes", F.lit(0.0))).otherwise(F.col("median_latency_minutes")).alias("Latency_Min"),
    ).orderBy(F.desc_nulls_last("Event_F1"), "Model", "Dataset")


def write_leaderboard(board: DataFrame, path: str) -> None:
    """metrics_summary.csv below path: a header and a row for each run, in the leaderboard's order. One file has one writer,
    which the rows pass one by one."""
    lines = board.select(F.lit("metrics_summary.csv").alias("path"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in board.columns])).alias("content"))
    write_files(lines.coalesce(1), path, ",".join(board.columns))


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    schema = "Model string, Dataset string, Event_F1 double, Precision double, Recall double, FP_per_Day double, Latency_Min double"
    return spark.read.schema(schema).option("header", True).csv(f"{path}/metrics_summary.csv")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Means over folds (f1, fp_per_day, latency); NaN counts as missing."""
    return folds.groupBy("Model").agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("f1", "fp_per_day", "latency")])
