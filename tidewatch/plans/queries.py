"""Registered queries over the event series, and the same in SQL. Doubles are rounded to 8 places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import state_space
from tidewatch.operators import diagnostics as D
from tidewatch.operators import events as E
from tidewatch.operators import metrics as M
from tidewatch.operators import plots
from tidewatch.operators import points as P
from tidewatch.operators import rolling as R
from tidewatch.plans import models, pipelines
from tidewatch.session import staging
from tidewatch.sources import results
from tidewatch.sources import series as S
from tidewatch.streaming import online

WIDTH = 3


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grid(spark, sf):
    return S.grid(_table(spark, sf, "events"))


def _labels(spark, sf):
    return S.top_event_times(_table(spark, sf, "events"))


def _marked(spark, sf):
    return E.mark(_grid(spark, sf), _labels(spark, sf), WIDTH)


def _scored(spark, sf):
    return R.rolling_sigma(_marked(spark, sf))


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in cols})


def _true_rows(spark, sf):
    return E.label_rows(_grid(spark, sf), _labels(spark, sf), WIDTH)


def _flags(spark, sf, k: float, least: int = 2) -> DataFrame:
    return M.flagged_by_k(_scored(spark, sf), "value", [k], least).drop("k")


def _sweep(spark, sf) -> DataFrame:
    return M.sweep_series(_scored(spark, sf), "value", M.K_GRID, 2)


_RATES = ("precision", "recall", "f1")


def series_grid(spark, sf):
    return _grid(spark, sf)


def series_index(spark, sf):
    return S.daily_orders(_table(spark, sf, "orders"))


def split_three_way(spark, sf):
    return P.split(_grid(spark, sf)).groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def tail_subsample(spark, sf):
    return P.tail(_grid(spark, sf), 0.5, 100).select("series_id", "idx", "value")


def label_lookup_fallback(spark, sf):
    top = _labels(spark, sf)
    own = top.filter("series_id < 'l'").select(F.col("series_id").alias("key"), "label_ts")
    other = top.select(F.concat(F.lit("data/"), "series_id").alias("key"), F.expr("label_ts + interval 1 hour").alias("label_ts"))
    empty = top.filter("series_id > 'u'").select(F.col("series_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("label_ts"))
    return S.labels_for(top.select("series_id"), own.unionByName(other).unionByName(empty))


def label_asof(spark, sf):
    return E.label_anchors(_grid(spark, sf), _labels(spark, sf)).select("series_id", "label_ts", "anchor")


def label_windows(spark, sf):
    return _marked(spark, sf).select("series_id", "idx", "is_anomaly")


def label_counts(spark, sf):
    s = P.split(_marked(spark, sf))
    return s.groupBy("series_id").agg(F.sum("is_anomaly").alias("total"), F.sum(F.when(F.col("split") == "Test", F.col("is_anomaly")).otherwise(0)).alias("in_test"))


def normalize_zscore(spark, sf):
    z = P.zscore(P.split(_grid(spark, sf)), scope=F.col("split") == "Train").withColumn("back", P.unscaled(F.col("z")))
    return _r(z.select("series_id", "idx", "z", "back"), "z", "back")


def mad_sigma(spark, sf):
    return _r(P.mad_scale(_grid(spark, sf)), "mad_sigma")


def residual_median_centered(spark, sf):
    return _r(P.centred(_grid(spark, sf), "value").select("series_id", "idx", "centred"), "centred")


def rolling_stats(spark, sf):
    return _r(R.rolling_stats(_grid(spark, sf)).select("series_id", "idx", "mean_roll", "std_roll"), "mean_roll", "std_roll")


def rolling_backfill(spark, sf):
    return _r(R.rolling_sigma(_grid(spark, sf)).select("series_id", "idx", "mean_roll", "std_roll"), "mean_roll", "std_roll")


def rolling_sigma_flags(spark, sf):
    return _scored(spark, sf).select("series_id", "idx", R.exceeds("value", F.lit(3.0)).cast("int").alias("flag"))


def residual_z_flags(mode, spark, sf):
    c = P.centred(_grid(spark, sf), "value")
    return R.residual_z(c, "centred", mode).select("series_id", "idx", "flag")


def interval_flags(spark, sf):
    s = P.zscore(P.split(_grid(spark, sf)), scope=F.col("split") == "Train")
    s = s.withColumns(P.band(F.col("mu"), F.col("sigma"), 1.96))
    return s.select("series_id", "idx", P.outside(F.col("value"), F.col("lower"), F.col("upper")).alias("detected"), P.beyond(F.col("value"), F.col("mu"), F.col("sigma"), 2.5).alias("beyond"))


def persistence_filter(spark, sf):
    return _flags(spark, sf, 2.0)


def event_merge(gap, spark, sf):
    return E.to_events(_flags(spark, sf, 2.0, 1), gap)


def event_overlap_tp(spark, sf):
    return E.hits(E.to_events(_flags(spark, sf, 2.0), 3), E.to_events(_true_rows(spark, sf), 3))


def event_overlap_fn(spark, sf):
    return E.missed(E.to_events(_flags(spark, sf, 2.0), 3), E.to_events(_true_rows(spark, sf), 3))


def pointwise_metrics(spark, sf):
    return _r(M.pointwise(_scored(spark, sf).withColumn("flag", R.exceeds("value", F.lit(2.0)).cast("int"))), *_RATES)


def event_metrics(spark, sf):
    return _r(M.sweep_series(_scored(spark, sf), "value", [2.0], 2).drop("k", "anomaly_rate"), *_RATES)


def business_metrics(spark, sf):
    m = M.business(_grid(spark, sf), E.to_events(_flags(spark, sf, 2.0), 3), E.to_events(_true_rows(spark, sf), 3))
    return _r(m, "duration_days", "fp_per_day", "median_latency_minutes")


def anomaly_rate(spark, sf):
    return _r(_sweep(spark, sf).select("series_id", "k", "anomaly_rate"), "anomaly_rate")


def threshold_sweep(spark, sf):
    return _r(_sweep(spark, sf), *_RATES, "anomaly_rate")


def threshold_best(spark, sf):
    return _r(M.best(_sweep(spark, sf)), "best_f1")


def threshold_best_validated(spark, sf):
    return _r(pipelines.validated(P.split(_marked(spark, sf)).filter("split != 'Train'"), "value").select("series_id", "best_k", "best_f1", "tp", "fp", "fn"), "best_f1")


def sliding_sequences(spark, sf):
    s = R.sequences(_grid(spark, sf))
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return s.select("series_id", "idx", F.round(F.col("target").cast("double"), 2).alias("target"), F.round(F.col("window")[0].cast("double"), 2).alias("first"), F.round(total, 1).alias("total"))


def lstm_score_rolling(spark, sf):
    c = P.centred(_grid(spark, sf), "value").withColumn("left", F.when(F.col("idx") >= 48, F.col("centred")))
    return _r(R.rolling_score(c, "left").select("series_id", "idx", "score"), "score")


def rolling_volatility(spark, sf):
    return _r(R.volatility(_grid(spark, sf)).select("series_id", "idx", "volatility"), "volatility")


def _score(spark, sf):
    return _scored(spark, sf).withColumn("score", F.round(F.abs(F.col("value") - F.col("mean_roll")) / (F.col("std_roll") + 1e-9), 8))


def ensemble_mean(spark, sf):
    s = _score(spark, sf).withColumns({"a": F.col("score"), "b": F.when(F.col("idx") >= 48, F.col("value") / 100), "c": F.lit(float("nan"))})
    return s.select("series_id", "idx", F.round(P.ensemble({"a": 1.0, "b": 2.0, "c": 1.0}), 10).alias("combined_score"))


def pr_curve(spark, sf):
    return _r(D.pr_curve(_score(spark, sf)), "precision", "recall")


def pr_auc(spark, sf):
    return _r(D.pr_auc(D.pr_curve(_score(spark, sf))), "auc")


def residual_kurtosis(spark, sf):
    return _r(D.moments(_grid(spark, sf)), "kurtosis", "mu", "sigma")


def residual_histogram(spark, sf):
    return _r(D.histogram(_grid(spark, sf)), "density")


def acf(spark, sf):
    return _r(D.acf(_grid(spark, sf)), "acf")


def pacf(spark, sf):
    return _r(D.pacf(D.acf(_grid(spark, sf))), "pacf")


def qq_points(spark, sf):
    return _r(D.qq(_grid(spark, sf)), "theoretical")


def leaderboard(spark, sf):
    m = _sweep(spark, sf).filter("k in (2.0, 3.0)")
    level = F.struct(*_RATES, "tp", "fp", "fn", "n_true_events", "n_pred_events")
    business = F.struct(F.col("anomaly_rate").alias("fp_per_day"), F.lit(None).cast("double").alias("median_latency_minutes"))
    rows = m.select(F.concat(F.lit("ROLLING_"), F.col("k").cast("int").cast("string")).alias("Model"), F.col("series_id").alias("Dataset"), F.when(F.col("n_pred_events") > 0, level).alias("event_level"), F.when(F.col("k") == 2.0, business).alias("business"), F.lit(1.5).alias("fp_per_day"), F.lit(None).cast("double").alias("median_latency_minutes"))
    return _r(results.leaderboard(rows), "Event_F1", "Precision", "Recall", "FP_per_Day")


def _model_rows(spark, sf, *more) -> DataFrame:
    """Event metrics of two thresholds as runs of two models, in the metrics files' form."""
    level = F.when(F.col("n_pred_events") > 0, F.struct(*_RATES, "tp", "fp", "fn", "n_true_events", "n_pred_events"))
    business = F.struct(F.col("anomaly_rate").alias("fp_per_day"), F.lit(float("nan")).alias("median_latency_minutes"))
    m = _sweep(spark, sf).filter("k in (2.0, 3.0)")
    return m.select(F.concat(F.lit("rolling_"), F.col("k").cast("int").cast("string")).alias("model"), F.concat(F.lit("events/"), "series_id").alias("series_id"), level.alias("event_level"), business.alias("business"), F.col("k").alias("best_k"))


def metrics_files(spark, sf):
    """Runs written as one metrics.json each, and what a scan of the folder finds."""
    path = staging(spark)
    results.write_metrics(_model_rows(spark, sf), path)
    found = results.scan_metrics(spark, path)
    return _r(found.select("Model", "Dataset", "best_k", F.col("event_level.f1").alias("f1"), F.col("event_level.tp").alias("tp"), F.col("business.fp_per_day").alias("fp_per_day"), F.isnan("business.median_latency_minutes").alias("no_latency")), "f1", "fp_per_day")


def leaderboard_file(spark, sf):
    """The leaderboard of those files, written as metrics_summary.csv and read back with its lines' numbers."""
    path = staging(spark)
    results.write_metrics(_model_rows(spark, sf), path)
    results.write_leaderboard(results.leaderboard(results.scan_metrics(spark, path)), path)
    return _r(results.read_leaderboard(spark, path).select("Model", "Dataset", "Event_F1", "Precision", "Recall", "FP_per_Day"), "Event_F1", "Precision", "Recall", "FP_per_Day")


def plot_points(spark, sf):
    """How many points of each layer a chart of values and rolling means keeps, and the sums of their places."""
    rows = R.rolling_stats(_grid(spark, sf))
    kept = plots.reduced(plots.points(rows, "value", "idx", "value").unionByName(plots.points(rows, "mean", "idx", "mean_roll")))
    return _r(kept.groupBy("series_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("px"), F.sum("y").alias("y")), "y")


def plot_files(spark, sf):
    """Charts of the rolling detector's values, means and flags, written as one SVG file a series, and their sizes."""
    path = staging(spark)
    rows = R.rolling_sigma(_grid(spark, sf)).withColumnRenamed("mean_roll", "pred_mean")
    hit = _flags(spark, sf, 2.0).withColumn("detected", F.lit(1))
    charts = plots.forecasts(rows.join(hit, ["series_id", "idx"], "left"))
    results.write_plots(charts.withColumn("model", F.lit("rolling")), path, "forecast_detected.svg")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.svg")
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("series_id"), F.length("value").cast("long").alias("size"))


def cv_summary(spark, sf):
    m = _sweep(spark, sf)
    folds = m.select(F.col("series_id").alias("Model"), "f1", F.col("anomaly_rate").alias("fp_per_day"), F.when(F.col("n_pred_events") > 0, F.col("k")).otherwise(F.lit(float("nan"))).alias("latency"))
    return _r(results.cv_summary(folds), "f1", "fp_per_day", "latency")


def bocpd_cp_prob(spark, sf):
    return _r(models.run_lengths(_marked(spark, sf)).select("series_id", "idx", "cp_prob"), "cp_prob")


def bocpd_map_run_length(spark, sf):
    return _r(models.run_lengths(_marked(spark, sf), eps=1e-9).select("series_id", "idx", "cp_prob", "map_run_length"), "cp_prob")


def bocpd_run_length_matrix(spark, sf):
    """The whole posterior, to 3 places; rows without a probability in them are left out."""
    return models.run_length_matrix(_grid(spark, sf)).withColumn("prob", F.round("prob", 3)).filter("prob > 0")


def first_runs(spark, sf):
    m = _sweep(spark, sf).filter("k in (2.0, 3.0)")
    return _r(results.first_runs(m.select(F.concat(F.lit("ROLLING_"), F.col("k").cast("int").cast("string")).alias("Model"), F.col("series_id").alias("Dataset"), "f1")), "f1")


def rows_at_flagged_times(spark, sf):
    g = _grid(spark, sf)
    return E.at_times(g, g.join(_flags(spark, sf, 2.0), ["series_id", "idx"])).select("series_id", "idx", "value")


def csv_series(spark, sf):
    """The grid, written as a CSV file for each series, half of them with other headers, and read back."""
    path, g = staging(spark), _grid(spark, sf).withColumn("series", F.col("series_id"))
    own = g.filter("series_id < 'l'").select("series", "ts", "value").withColumnsRenamed({"ts": "timestamp"})
    odd = g.filter("series_id >= 'l'").select("series", F.col("ts").alias("when"), F.col("value").alias("count"), F.lit("x").alias("note"))
    for name, rows in (("own", own), ("odd", odd)):
        rows.repartition("series").write.partitionBy("series").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}/{name}")
    read = S.read_csv(spark, f"{path}/*/*/*.csv", path)
    return read.select(F.regexp_extract("series_id", "series=([^/]*)/", 1).alias("series_id"), "idx", "ts", "value")


def stream_windows(spark, sf):
    """The grid's cells as a stream gives them out, up to the watermark."""
    path = staging(spark)
    return online.run_available(online.stream_grid(online.events_stream(spark, f"{sf}/event[s].parquet")), f"{path}/out", f"{path}/state")


def online_run_lengths(spark, sf):
    """Likeliest run lengths of the grid's values, standardised, as a stream of them goes through the state."""
    path = staging(spark)
    z = P.zscore(_grid(spark, sf)).select("series_id", "ts", F.col("z").alias("value"))
    z.write.parquet(f"{path}/in")  # read in one trigger, in which each series' rows are put in order
    stream = spark.readStream.schema(z.schema).parquet(f"{path}/in")
    return online.run_available(online.online_changepoints(stream), f"{path}/out", f"{path}/state").select("series_id", "ts", "map_run_length")


def _predictions(frame: DataFrame, *cols: str) -> DataFrame:
    return frame.select("series_id", "idx", "ts", "value", "pred_mean", *cols, "detected")


def predictions_kalman(spark, sf):
    return _predictions(pipelines.kalman(_marked(spark, sf), rows=True), "pred_lower", "pred_upper", "lower", "upper")


def predictions_bsts(spark, sf):
    return _predictions(pipelines.bsts(_marked(spark, sf), rows=True), "pred_lower", "pred_upper", "resid")


def predictions_gp(spark, sf):
    return _predictions(pipelines.gaussian_process(_marked(spark, sf), rows=True), "pred_std", "resid")


def local_level_filter(spark, sf):
    return _r(models.level_filter(_marked(spark, sf)).select("series_id", "idx", "level", "level_var"), "level", "level_var")


def stl_decompose(spark, sf):
    return models.decompose(_marked(spark, sf))


def local_level_forecast(spark, sf):
    return models.local_level_forecast(_marked(spark, sf))


def local_trend_forecast(spark, sf):
    return models.structural_forecast(_marked(spark, sf), 0.5, state_space.Structural())


def bsts_forecast(spark, sf):
    return models.bsts_forecast(_marked(spark, sf))


def bsts_dummy_forecast(spark, sf):
    return models.structural_forecast(_marked(spark, sf), 0.5, state_space.Structural(dummy=48))


def gp_forecast(spark, sf):
    return models.gp_forecast(_marked(spark, sf))


def gp_simple_forecast(spark, sf):
    return models.gp_forecast(_marked(spark, sf), kernel=models.simple_kernel(), restarts=3)


def lstm_forecast(spark, sf):
    return models.lstm_forecast(_marked(spark, sf), layers=1, epochs=20, scale="train")


def hybrid_scores(spark, sf):
    return pipelines.hybrid_scores(_marked(spark, sf))


def pipeline_kalman(spark, sf):
    return pipelines.kalman(_marked(spark, sf))


def pipeline_bsts(spark, sf):
    return pipelines.bsts(_marked(spark, sf))


def pipeline_gp(spark, sf):
    return pipelines.gaussian_process(_marked(spark, sf))


def pipeline_stl_baseline(spark, sf):
    return pipelines.stl_baseline(_marked(spark, sf))


def pipeline_lstm(spark, sf):
    return pipelines.lstm(_marked(spark, sf))


def pipeline_hybrid(spark, sf):
    return pipelines.hybrid(_marked(spark, sf))


def pipeline_bsts_dummy(spark, sf):
    return pipelines.bsts_dummy(_marked(spark, sf))


def pipeline_bsts_enhanced(spark, sf):
    return pipelines.bsts_enhanced(_marked(spark, sf))


def pipeline_lstm_raw(spark, sf):
    return pipelines.lstm_raw(_marked(spark, sf))


def pipeline_gp_simple(spark, sf):
    return pipelines.gaussian_process_simple(_marked(spark, sf))


def pipeline_changepoints(spark, sf):
    return _r(pipelines.changepoints(_marked(spark, sf)).select("series_id", "idx", "cp_prob", "map_run_length", "highlight"), "cp_prob")


def benchmark_leaderboard(spark, sf):
    return pipelines.ranked(pipelines.benchmark(_marked(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        series_grid, series_index, split_three_way, tail_subsample, label_lookup_fallback, label_asof, label_windows, label_counts, normalize_zscore, mad_sigma,
        residual_median_centered, rolling_stats, rolling_backfill, rolling_sigma_flags, interval_flags, persistence_filter, event_overlap_tp, event_overlap_fn,
        pointwise_metrics, event_metrics, business_metrics, anomaly_rate, threshold_sweep, threshold_best, threshold_best_validated, sliding_sequences,
        lstm_score_rolling, rolling_volatility, ensemble_mean, pr_curve, pr_auc, residual_kurtosis, residual_histogram, acf, pacf, qq_points, leaderboard,
        cv_summary, bocpd_cp_prob, bocpd_map_run_length, bocpd_run_length_matrix, local_level_filter, stl_decompose, local_level_forecast, local_trend_forecast,
        bsts_forecast, bsts_dummy_forecast, gp_forecast, gp_simple_forecast, lstm_forecast, hybrid_scores, pipeline_kalman, pipeline_bsts, pipeline_gp,
        pipeline_stl_baseline, pipeline_lstm, pipeline_hybrid, pipeline_bsts_dummy, pipeline_bsts_enhanced, pipeline_lstm_raw, pipeline_gp_simple,
        pipeline_changepoints, benchmark_leaderboard, first_runs, rows_at_flagged_times, csv_series, stream_windows, online_run_lengths,
        predictions_kalman, predictions_bsts, predictions_gp, metrics_files, leaderboard_file, plot_points, plot_files,
    )
    found = {f.__name__: f for f in plain}
    found |= {f"residual_z_flags_{m}": partial(residual_z_flags, m) for m in ("std", "mad", "rolling")}
    return found | {f"event_merge_gap{g}": partial(event_merge, g) for g in (0, 1, 3)}


_BASE = {
    "cells": "SELECT event_type AS series_id, time_bucket(INTERVAL '30 minutes', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2",
    "steps": "SELECT lo + i * INTERVAL '30 minutes' AS ts, i AS idx FROM (SELECT lo, unnest(range(0, CAST((epoch(hi) - epoch(lo)) / 1800 AS BIGINT) + 1)) AS i FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM cells))",
    "s": "SELECT d.series_id, p.idx, p.ts, coalesce(c.v, 0.0) AS value, count(*) OVER (PARTITION BY d.series_id) AS n FROM (SELECT DISTINCT series_id FROM cells) d CROSS JOIN steps p LEFT JOIN cells c ON c.series_id = d.series_id AND c.ts = p.ts",
    "lab": "SELECT event_type AS series_id, ts AS label_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5",
    "anchor": "SELECT l.series_id, l.label_ts, coalesce(min(s.idx), max(z.n)) AS anchor, max(z.n) AS n FROM (SELECT DISTINCT * FROM lab) l JOIN (SELECT DISTINCT series_id, n FROM s) z ON z.series_id = l.series_id LEFT JOIN s ON s.series_id = l.series_id AND s.ts >= l.label_ts GROUP BY 1, 2",
    "m": "SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM anchor a WHERE a.series_id = s.series_id AND s.idx BETWEEN greatest(0, a.anchor - 3) AND least(a.n - 1, a.anchor + 3)) THEN 1 ELSE 0 END AS is_anomaly, CASE WHEN idx < floor(n * 0.5) THEN 'Train' WHEN idx < floor(n * 0.75) THEN 'Validation' ELSE 'Test' END AS split FROM s",
    "roll": "SELECT *, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS mean_roll, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS std_roll FROM m WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)",
    "fill": "SELECT * EXCLUDE (mean_roll, std_roll), first_value(mean_roll IGNORE NULLS) OVER f AS mean_roll, first_value(std_roll IGNORE NULLS) OVER f AS std_roll FROM roll WINDOW f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "ks": "SELECT CAST(2.0 + 0.5 * i AS DOUBLE) AS k FROM (SELECT unnest(range(17)) AS i)",
    "fl": "SELECT series_id, k, idx FROM fill, ks WHERE abs(value - mean_roll) > k * (std_roll + 1e-6)",
    "per": "SELECT series_id, k, idx FROM (SELECT *, count(*) OVER (PARTITION BY series_id, k, run) AS c FROM (SELECT *, idx - row_number() OVER (PARTITION BY series_id, k ORDER BY idx) AS run FROM fl)) WHERE c >= 2",
    "pe": "SELECT series_id, k, min(idx) AS start_idx, max(idx) AS end_idx FROM (SELECT *, sum(new) OVER (PARTITION BY series_id, k ORDER BY idx) AS e FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id, k ORDER BY idx) <= 4 THEN 0 ELSE 1 END AS new FROM per)) GROUP BY series_id, k, e",
    "te": "SELECT series_id, min(idx) AS start_idx, max(idx) AS end_idx FROM (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY idx) AS e FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) <= 4 THEN 0 ELSE 1 END AS new FROM m WHERE is_anomaly = 1)) GROUP BY series_id, e",
    "counts": "SELECT z.series_id, ks.k, z.n, (SELECT count(*) FROM pe p WHERE p.series_id = z.series_id AND p.k = ks.k) AS n_pred_events, (SELECT count(*) FROM te t WHERE t.series_id = z.series_id) AS n_true_events, (SELECT count(*) FROM pe p WHERE p.series_id = z.series_id AND p.k = ks.k AND EXISTS (SELECT 1 FROM te t WHERE t.series_id = p.series_id AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx)) AS tp, (SELECT count(*) FROM te t WHERE t.series_id = z.series_id AND EXISTS (SELECT 1 FROM pe p WHERE p.series_id = t.series_id AND p.k = ks.k AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx)) AS found, (SELECT count(*) FROM per f WHERE f.series_id = z.series_id AND f.k = ks.k) AS n_flags FROM (SELECT DISTINCT series_id, n FROM s) z CROSS JOIN ks",
    "sw": "SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM (SELECT series_id, k, tp, n_pred_events - tp AS fp, n_true_events - found AS fn, n_true_events, n_pred_events, tp / (n_pred_events + 1e-9) AS precision, found / (n_true_events + 1e-9) AS recall, CAST(n_flags AS DOUBLE) / n AS anomaly_rate FROM counts)",
    "med": "SELECT series_id, median(value) AS m, avg(value) AS mu_all, stddev_pop(value) AS sd_all FROM s GROUP BY 1",
    "sc": "SELECT *, round(abs(value - mean_roll) / (std_roll + 1e-9), 8) AS score FROM fill",
    "prc": "SELECT series_id, threshold, CAST(sum(pos) OVER d AS DOUBLE) / sum(cnt) OVER d AS precision, CAST(sum(pos) OVER d AS DOUBLE) / sum(pos) OVER (PARTITION BY series_id) AS recall FROM (SELECT series_id, score AS threshold, sum(is_anomaly) AS pos, count(*) AS cnt FROM sc WHERE score IS NOT NULL GROUP BY 1, 2) WINDOW d AS (PARTITION BY series_id ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)",
}
_SWEPT = "round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1"
_MERGE = "SELECT series_id, min(idx) AS start_idx, max(idx) AS end_idx FROM (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY idx) AS e FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) <= {} THEN 0 ELSE 1 END AS new FROM fl WHERE k = 2)) GROUP BY series_id, e"
_Z = "SELECT series_id, idx, CASE WHEN scale > 0 AND abs(c) / scale > 3 THEN 1 ELSE 0 END AS flag FROM ({})"
_TAILS = {
    "series_grid": "SELECT series_id, CAST(idx AS BIGINT) AS idx, ts, value FROM s",
    "split_three_way": "SELECT series_id, split, count(*) AS n, min(idx) AS first, max(idx) AS last FROM m GROUP BY 1, 2",
    "tail_subsample": "SELECT series_id, idx, value FROM s WHERE idx < floor(n * 0.5) AND idx >= greatest(0, floor(n * 0.5) - 100)",
    "label_lookup_fallback": "SELECT DISTINCT series_id, label_ts FROM lab WHERE series_id < 'l' UNION ALL SELECT series_id, label_ts + INTERVAL 1 HOUR FROM lab WHERE series_id >= 'l' AND series_id <= 'u'",
    "label_asof": "SELECT series_id, label_ts, CAST(anchor AS BIGINT) AS anchor FROM anchor",
    "label_windows": "SELECT series_id, idx, is_anomaly FROM m",
    "label_counts": "SELECT series_id, CAST(sum(is_anomaly) AS BIGINT) AS total, CAST(sum(CASE WHEN split = 'Test' THEN is_anomaly ELSE 0 END) AS BIGINT) AS in_test FROM m GROUP BY 1",
    "normalize_zscore": "SELECT m.series_id, idx, round((value - mu) / sd, 8) AS z, round((value - mu) / sd * sd + mu, 8) AS back FROM m JOIN (SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM m WHERE split = 'Train' GROUP BY 1) t ON t.series_id = m.series_id",
    "mad_sigma": "SELECT s.series_id, round(median(abs(value - med.m)) * 1.4826, 8) AS mad_sigma FROM s JOIN med ON med.series_id = s.series_id GROUP BY 1",
    "residual_median_centered": "SELECT s.series_id, idx, round(value - med.m, 8) AS centred FROM s JOIN med ON med.series_id = s.series_id",
    "rolling_stats": "SELECT series_id, idx, round(mean_roll, 8) AS mean_roll, round(std_roll, 8) AS std_roll FROM roll",
    "rolling_backfill": "SELECT series_id, idx, round(mean_roll, 8) AS mean_roll, round(std_roll, 8) AS std_roll FROM fill",
    "rolling_sigma_flags": "SELECT series_id, idx, CASE WHEN abs(value - mean_roll) > 3 * (std_roll + 1e-6) THEN 1 ELSE 0 END AS flag FROM fill",
    "residual_z_flags_std": _Z.format("SELECT s.series_id, idx, value - m AS c, stddev_samp(value - m) OVER (PARTITION BY s.series_id) AS scale FROM s JOIN med ON med.series_id = s.series_id"),
    "residual_z_flags_mad": _Z.format("SELECT *, median(abs(c - cm)) OVER (PARTITION BY series_id) * 1.4826 AS scale FROM (SELECT *, median(c) OVER (PARTITION BY series_id) AS cm FROM (SELECT s.series_id, idx, value - m AS c FROM s JOIN med ON med.series_id = s.series_id))"),
    "residual_z_flags_rolling": _Z.format("SELECT series_id, idx, c, CASE WHEN sd = 0 THEN 1.0 ELSE sd END AS scale FROM (SELECT *, first_value(sd0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sd FROM (SELECT *, CASE WHEN count(c) OVER w >= 5 THEN stddev_samp(c) OVER w END AS sd0 FROM (SELECT s.series_id, idx, value - m AS c FROM s JOIN med ON med.series_id = s.series_id) WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))"),
    "interval_flags": "SELECT m.series_id, idx, CASE WHEN value < mu - 1.96 * sd OR value > mu + 1.96 * sd THEN 1 ELSE 0 END AS detected, CASE WHEN abs(value - mu) > 2.5 * sd THEN 1 ELSE 0 END AS beyond FROM m JOIN (SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM m WHERE split = 'Train' GROUP BY 1) t ON t.series_id = m.series_id",
    "persistence_filter": "SELECT series_id, idx FROM per WHERE k = 2",
    "event_merge_gap0": _MERGE.format(1),
    "event_merge_gap1": _MERGE.format(2),
    "event_merge_gap3": _MERGE.format(4),
    "event_overlap_tp": "SELECT series_id, start_idx, end_idx FROM pe p WHERE k = 2 AND EXISTS (SELECT 1 FROM te t WHERE t.series_id = p.series_id AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx)",
    "event_overlap_fn": "SELECT series_id, start_idx, end_idx FROM te t WHERE NOT EXISTS (SELECT 1 FROM pe p WHERE k = 2 AND t.series_id = p.series_id AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx)",
    "pointwise_metrics": f"SELECT series_id, tp, fp, fn, {_SWEPT} FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM (SELECT series_id, CAST(sum(f * is_anomaly) AS DOUBLE) AS tp, CAST(sum(f * (1 - is_anomaly)) AS DOUBLE) AS fp, CAST(sum((1 - f) * is_anomaly) AS DOUBLE) AS fn FROM (SELECT *, CASE WHEN abs(value - mean_roll) > 2 * (std_roll + 1e-6) THEN 1 ELSE 0 END AS f FROM fill) GROUP BY 1)))",
    "event_metrics": f"SELECT series_id, tp, fp, fn, n_true_events, n_pred_events, {_SWEPT} FROM sw WHERE k = 2",
    "business_metrics": "SELECT z.series_id, round(days, 8) AS duration_days, sw.fp AS fp_count, round(sw.fp / days, 8) AS fp_per_day, round(l.late, 8) AS median_latency_minutes FROM (SELECT series_id, (epoch(max(ts)) - epoch(min(ts))) / 86400.0 AS days FROM s GROUP BY 1) z JOIN sw ON sw.series_id = z.series_id AND sw.k = 2 LEFT JOIN (SELECT series_id, median(d) AS late FROM (SELECT t.series_id, t.start_idx, (min(p.start_idx) - t.start_idx) * 30.0 AS d FROM te t JOIN pe p ON p.k = 2 AND p.series_id = t.series_id AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx GROUP BY 1, 2) GROUP BY 1) l ON l.series_id = z.series_id",
    "anomaly_rate": "SELECT series_id, k, round(anomaly_rate, 8) AS anomaly_rate FROM sw",
    "threshold_sweep": f"SELECT series_id, k, tp, fp, fn, n_true_events, n_pred_events, round(anomaly_rate, 8) AS anomaly_rate, {_SWEPT} FROM sw",
    "threshold_best": "SELECT z.series_id, coalesce(b.k, 3.0) AS best_k, round(b.f1, 8) AS best_f1 FROM (SELECT DISTINCT series_id FROM s) z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f1 DESC, k) AS r FROM sw WHERE anomaly_rate <= 0.1) b ON b.series_id = z.series_id AND r = 1",
    "sliding_sequences": "SELECT series_id, idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) AS target, round(CAST(CAST(lag(value, 48) OVER o AS FLOAT) AS DOUBLE), 2) AS first, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), 1) AS total FROM s WINDOW o AS (PARTITION BY series_id ORDER BY idx) QUALIFY idx >= 48",
    "lstm_score_rolling": "SELECT series_id, idx, round(coalesce(abs(l) / (sd + 1e-9), 0.0), 8) AS score FROM (SELECT *, first_value(sd0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sd FROM (SELECT *, stddev_samp(l) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS sd0 FROM (SELECT s.series_id, idx, CASE WHEN idx >= 48 THEN value - m END AS l FROM s JOIN med ON med.series_id = s.series_id)))",
    "rolling_volatility": "SELECT series_id, idx, CASE WHEN idx >= 47 THEN round(stddev_samp(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 8) END AS volatility FROM s",
    "ensemble_mean": "SELECT series_id, idx, round((coalesce(score, 0.0) + CASE WHEN idx >= 48 THEN value / 100 ELSE 0.0 END * 2) / 4, 10) AS combined_score FROM sc",
    "pr_curve": "SELECT series_id, threshold, round(precision, 8) AS precision, round(recall, 8) AS recall FROM prc",
    "pr_auc": "SELECT series_id, round(sum((recall - r0) * (precision + p0) / 2), 8) AS auc FROM (SELECT *, lag(recall, 1, 0.0) OVER w AS r0, lag(precision, 1, 1.0) OVER w AS p0 FROM prc WINDOW w AS (PARTITION BY series_id ORDER BY threshold DESC)) GROUP BY 1",
    "residual_kurtosis": "SELECT series_id, round(kurtosis_pop(value), 8) AS kurtosis, round(avg(value), 8) AS mu, round(stddev_pop(value), 8) AS sigma FROM s GROUP BY 1",
    "residual_histogram": "SELECT series_id, bin, count(*) AS n, round(count(*) / (max(n) * max(width)), 8) AS density FROM (SELECT series_id, n, width, CAST(least(floor((value - lo) / width) + 1, 50) AS INTEGER) AS bin FROM (SELECT *, min(value) OVER w AS lo, (max(value) OVER w - min(value) OVER w) / 50 AS width FROM s WINDOW w AS (PARTITION BY series_id))) GROUP BY 1, 2",
    "acf": "SELECT a.series_id, CAST(h AS INTEGER) AS lag, round(sum(a.d * b.d) / max(v), 8) AS acf FROM (SELECT s.series_id, idx, value - mu_all AS d FROM s JOIN med ON med.series_id = s.series_id) a CROSS JOIN (SELECT unnest(range(51)) AS h) JOIN (SELECT s.series_id, idx, value - mu_all AS d FROM s JOIN med ON med.series_id = s.series_id) b ON b.series_id = a.series_id AND b.idx = a.idx - h JOIN (SELECT series_id, sum(d * d) AS v FROM (SELECT s.series_id, value - mu_all AS d FROM s JOIN med ON med.series_id = s.series_id) GROUP BY 1) z ON z.series_id = a.series_id GROUP BY 1, 2",
    "leaderboard": "SELECT 'ROLLING_' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS \"Model\", series_id AS \"Dataset\", CASE WHEN n_pred_events > 0 THEN round(f1, 8) END AS \"Event_F1\", CASE WHEN n_pred_events > 0 THEN round(precision, 8) END AS \"Precision\", CASE WHEN n_pred_events > 0 THEN round(recall, 8) END AS \"Recall\", CASE WHEN k = 2 THEN round(anomaly_rate, 8) ELSE 1.5 END AS \"FP_per_Day\", CASE WHEN k = 2 THEN 0.0 END AS \"Latency_Min\" FROM sw WHERE k IN (2, 3)",
    "cv_summary": "SELECT series_id AS \"Model\", round(avg(f1), 8) AS f1, round(avg(anomaly_rate), 8) AS fp_per_day, round(avg(CASE WHEN n_pred_events > 0 THEN k END), 8) AS latency FROM sw GROUP BY 1",
    "csv_series": "SELECT series_id, CAST(idx AS BIGINT) AS idx, ts, value FROM s",
    "first_runs": "SELECT 'ROLLING_' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS \"Model\", series_id AS \"Dataset\", round(f1, 8) AS f1 FROM sw WHERE k IN (2, 3) QUALIFY row_number() OVER (PARTITION BY k ORDER BY series_id) = 1",
    "rows_at_flagged_times": "SELECT series_id, idx, value FROM s WHERE EXISTS (SELECT 1 FROM per p JOIN s t ON t.series_id = p.series_id AND t.idx = p.idx WHERE p.k = 2 AND p.series_id = s.series_id AND t.ts = s.ts)",
    "metrics_files": "SELECT 'ROLLING_' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS \"Model\", 'events__' || series_id AS \"Dataset\", k AS best_k, CASE WHEN n_pred_events > 0 THEN round(f1, 8) END AS f1, CASE WHEN n_pred_events > 0 THEN CAST(tp AS BIGINT) END AS tp, round(anomaly_rate, 8) AS fp_per_day, TRUE AS no_latency FROM sw WHERE k IN (2, 3)",
    "leaderboard_file": "SELECT 'ROLLING_' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS \"Model\", 'events__' || series_id AS \"Dataset\", CASE WHEN n_pred_events > 0 THEN round(f1, 8) END AS \"Event_F1\", CASE WHEN n_pred_events > 0 THEN round(precision, 8) END AS \"Precision\", CASE WHEN n_pred_events > 0 THEN round(recall, 8) END AS \"Recall\", round(anomaly_rate, 8) AS \"FP_per_Day\" FROM sw WHERE k IN (2, 3)",
    "plot_points": "SELECT series_id, layer, count(*) AS n, CAST(sum(px) AS BIGINT) AS px, round(sum(y), 8) AS y FROM (SELECT *, row_number() OVER (PARTITION BY series_id, layer, px ORDER BY y, idx) AS low, row_number() OVER (PARTITION BY series_id, layer, px ORDER BY y DESC, idx DESC) AS high FROM (SELECT series_id, layer, idx, y, floor((idx - min(idx) OVER (PARTITION BY series_id)) / (max(idx) OVER (PARTITION BY series_id) - min(idx) OVER (PARTITION BY series_id))::DOUBLE * 959) AS px FROM (SELECT series_id, 'value' AS layer, idx, value AS y FROM roll UNION ALL SELECT series_id, 'mean', idx, mean_roll FROM roll WHERE mean_roll IS NOT NULL))) WHERE low = 1 OR high = 1 GROUP BY series_id, layer",
    "stream_windows": "SELECT series_id, ts, v AS value FROM cells WHERE ts + INTERVAL 90 MINUTES <= (SELECT max(ts) FROM events)",
    "qq_points": f"SELECT series_id, nth, round({D.normal_quantile('p')}, 8) AS theoretical, ordered FROM (SELECT *, CASE WHEN nth = n THEN pow(0.5, 1 / n) WHEN nth = 1 THEN 1 - pow(0.5, 1 / n) ELSE (nth - 0.3175) / (n + 0.365) END AS p FROM (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY value, idx) AS INTEGER) AS nth, n, value AS ordered FROM s))",
}


#: Levinson and Durbin's recursion over the list of autocorrelations; r[k + 1] is that of lag k.
_PACF = """rr AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM ({acf}) GROUP BY series_id),
f AS (SELECT series_id, 1 AS lag, [r[2]] AS phi, r[2] AS a FROM rr UNION ALL
SELECT series_id, lag + 1, list_concat(list_transform(range(1, lag + 1), lambda j: phi[j] - a * phi[lag + 1 - j]), [a]), a FROM (
SELECT f.series_id, f.lag, f.phi, (rr.r[f.lag + 2] - list_sum(list_transform(range(1, f.lag + 1), lambda j: f.phi[j] * rr.r[f.lag + 2 - j]))) / (1 - list_sum(list_transform(range(1, f.lag + 1), lambda j: f.phi[j] * rr.r[j + 1]))) AS a
FROM f JOIN rr ON rr.series_id = f.series_id WHERE f.lag < 50))
SELECT series_id, CAST(0 AS INTEGER) AS lag, CAST(1 AS DOUBLE) AS pacf FROM rr UNION ALL SELECT series_id, CAST(lag AS INTEGER), round(a, 8) FROM f"""
#: The posterior over run lengths, longest last, with its means and scales; j - 1 is the run length.
_RUNS = """z AS (SELECT series_id, idx, ts, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + {sd}) AS x FROM s WINDOW w AS (PARTITION BY series_id)),
g AS (SELECT series_id, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS TIMESTAMP) AS ts, [CAST(1 AS DOUBLE)] AS r, [CAST(0 AS DOUBLE)] AS mu, [CAST(1 AS DOUBLE)] AS beta FROM (SELECT DISTINCT series_id FROM s) UNION ALL
SELECT series_id, idx, ts, list_transform(list_concat([0.01 * t], list_transform(m, lambda v: 0.99 * v)), lambda v: v / (t + {eps})),
list_concat([CAST(0 AS DOUBLE)], list_transform(range(1, len(mu) + 1), lambda j: (j * mu[j] + x) / (j + 1))),
list_concat([CAST(1 AS DOUBLE)], list_transform(range(1, len(mu) + 1), lambda j: beta[j] + j * (x - mu[j]) * (x - mu[j]) / (2 * (j + 1))))
FROM (SELECT *, list_sum(m) AS t FROM (SELECT g.series_id, z.idx, z.ts, z.x, g.mu, g.beta, list_transform(range(1, len(g.r) + 1), lambda j: g.r[j] * exp(lgamma((j + 2) / 2) - lgamma((j + 1) / 2) - 0.5 * ln((j + 1) * pi() * 2 * g.beta[j] / j) - (j + 2) / 2 * ln(1 + (z.x - g.mu[j]) * (z.x - g.mu[j]) / ((j + 1) * 2 * g.beta[j] / j)))) AS m
FROM g JOIN z ON z.series_id = g.series_id AND z.idx = g.idx + 1)))
{tail}"""
_MAP = "CAST(list_position(r, list_max(r)) - 1 AS {}) AS map_run_length"


def oracle_sql() -> dict[str, str]:
    base = "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" if k in ("s", "fill", "per", "pe", "te", "counts") else f"{k} AS ({v})" for k, v in _BASE.items())
    found = {k: f"{base} {v}" for k, v in _TAILS.items()}
    # the threshold is chosen on the validation part, where rolling state starts anew
    parts = {k: v for k, v in _BASE.items()}
    parts["m"] = f"SELECT * FROM ({_BASE['m']}) WHERE split <> 'Train'"
    parts["roll"] = _BASE["roll"].replace("PARTITION BY series_id ORDER", "PARTITION BY series_id, split ORDER")
    parts["fill"] = _BASE["fill"].replace("PARTITION BY series_id ORDER", "PARTITION BY series_id, split ORDER")
    for k in ("fl", "per", "pe", "te"):
        parts[k] = _BASE[k].replace("SELECT series_id, k", "SELECT series_id, split, k").replace("PARTITION BY series_id, k", "PARTITION BY series_id, split, k").replace("GROUP BY series_id, k", "GROUP BY series_id, split, k")
    parts["te"] = _BASE["te"].replace("SELECT series_id, min", "SELECT series_id, split, min").replace("PARTITION BY series_id ORDER", "PARTITION BY series_id, split ORDER").replace("GROUP BY series_id, e", "GROUP BY series_id, split, e")
    meet = "t.series_id = p.series_id AND t.split = p.split AND t.start_idx <= p.end_idx AND t.end_idx >= p.start_idx"
    parts["counts"] = f"SELECT z.series_id, z.split, ks.k, z.n, (SELECT count(*) FROM pe p WHERE p.series_id = z.series_id AND p.split = z.split AND p.k = ks.k) AS n_pred_events, (SELECT count(*) FROM te t WHERE t.series_id = z.series_id AND t.split = z.split) AS n_true_events, (SELECT count(*) FROM pe p WHERE p.series_id = z.series_id AND p.split = z.split AND p.k = ks.k AND EXISTS (SELECT 1 FROM te t WHERE {meet})) AS tp, (SELECT count(*) FROM te t WHERE t.series_id = z.series_id AND t.split = z.split AND EXISTS (SELECT 1 FROM pe p WHERE p.k = ks.k AND {meet})) AS found, (SELECT count(*) FROM per f WHERE f.series_id = z.series_id AND f.split = z.split AND f.k = ks.k) AS n_flags FROM (SELECT series_id, split, count(*) AS n FROM m GROUP BY 1, 2) z CROSS JOIN ks"
    parts["sw"] = _BASE["sw"].replace("SELECT series_id, k", "SELECT series_id, split, k")
    for k in ("med", "sc", "prc"):
        parts.pop(k)
    base2 = "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items())
    found["threshold_best_validated"] = f"{base2}, b AS (SELECT z.series_id, coalesce(x.k, 3.0) AS best_k, x.f1 AS best_f1 FROM (SELECT DISTINCT series_id FROM m) z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f1 DESC, k) AS r FROM sw WHERE split = 'Validation' AND anomaly_rate <= 0.1) x ON x.series_id = z.series_id AND r = 1) SELECT b.series_id, b.best_k, round(b.best_f1, 8) AS best_f1, sw.tp, sw.fp, sw.fn FROM b JOIN sw ON sw.series_id = b.series_id AND sw.split = 'Test' AND sw.k = b.best_k"
    found["series_index"] = "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, value) - 1 AS idx, ts, value FROM (SELECT o_orderstatus AS series_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"
    rec = base.replace("WITH ", "WITH RECURSIVE ", 1)
    found["pacf"] = f"{rec}, " + _PACF.format(acf=_TAILS["acf"].replace("round(sum(a.d * b.d) / max(v), 8)", "sum(a.d * b.d) / max(v)"))
    runs = lambda tail, eps="1e-9", sd="1e-9": f"{rec}, " + _RUNS.format(tail=f"SELECT {tail} FROM g WHERE idx >= 0", eps=eps, sd=sd)
    found["bocpd_cp_prob"] = runs("series_id, idx, round(r[1], 8) AS cp_prob", "0", "0")
    found["bocpd_map_run_length"] = runs(f"series_id, idx, round(r[1], 8) AS cp_prob, {_MAP.format('DOUBLE')}")
    found["pipeline_changepoints"] = runs(f"series_id, idx, round(r[1], 8) AS cp_prob, {_MAP.format('DOUBLE')}, CAST(r[1] > 0.5 AS INTEGER) AS highlight", "0", "0")
    found["online_run_lengths"] = runs(f"series_id, ts, {_MAP.format('BIGINT')}", "0", "0")
    found["bocpd_run_length_matrix"] = runs("series_id, idx, run_length, round(prob, 3) AS prob FROM (SELECT series_id, idx, unnest(range(len(r))) AS run_length, unnest(r) AS prob").replace(" FROM g WHERE idx >= 0", " FROM g WHERE idx >= 0) WHERE round(prob, 3) > 0")
    found["local_level_filter"] = f"{rec}, f AS (SELECT series_id, idx, value AS level, CAST(1.0 AS DOUBLE) AS p FROM s WHERE idx = 0 UNION ALL SELECT s.series_id, s.idx, f.level + (f.p + 0.1) / (f.p + 1.1) * (s.value - f.level), (1 - (f.p + 0.1) / (f.p + 1.1)) * (f.p + 0.1) FROM f JOIN s ON s.series_id = f.series_id AND s.idx = f.idx + 1) SELECT series_id, idx, round(level, 8) AS level, round(p, 8) AS level_var FROM f"
    return found
