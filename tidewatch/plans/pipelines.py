"""Detectors end to end: forecast, residual, threshold, persistence, events, metrics."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from functools import partial, reduce, wraps

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import gaussian_process as gaussian
from tidewatch.functions import state_space
from tidewatch.functions.stl import stl
from tidewatch.operators import events as E
from tidewatch.operators import metrics as M
from tidewatch.operators import points as P
from tidewatch.operators import rolling as R
from tidewatch.plans import models
from tidewatch.session import drop, saved, staging
from tidewatch.sources import results

PERSIST, GAP = 2, 3


_KEPT: list[list[tuple[DataFrame, str]]] = []


def once(rows: DataFrame) -> DataFrame:
    """Keep what several branches of a plan read as a stage table until the detector's result is written. A cache in its
    place would leave all windows, sorts and joins on one key to a single task, one upon the other, each with its memory."""
    if not _KEPT or any(rows is table for table, _ in _KEPT[-1]):
        return rows
    path = f"{staging(rows.sparkSession)}/once"
    _KEPT[-1].append((saved(rows, path), path))
    return _KEPT[-1][-1][0]


@contextlib.contextmanager
def kept():
    """Let go at the end of what once() keeps inside."""
    _KEPT.append([])
    try:
        yield
    finally:
        for rows, path in _KEPT.pop():
            drop(rows.sparkSession, path)


def whole(detector: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A detector that runs when it is called: its result is a stage table, and nothing stays in the executors' memory."""

    @wraps(detector)
    def run(series: DataFrame, *args, **settings) -> DataFrame:
        with kept():
            return saved(detector(series, *args, **settings), f"{staging(series.sparkSession)}/{detector.__name__}")

    return run


def _part(series: DataFrame, train: float) -> DataFrame:
    """The rows after the training part."""
    return P.with_length(series).filter(F.col("idx") >= F.floor(F.col("n") * train)).drop("n")


def _true(test: DataFrame) -> DataFrame:
    return test.filter("is_anomaly = 1").select("series_id", "idx")


def detections(test: DataFrame, flagged: DataFrame) -> DataFrame:
    """The judged rows with detected, 0 or 1."""
    hit = E.rows_of(E.as_runs(flagged)).withColumn("detected", F.lit(1))
    return test.join(hit, ["series_id", "idx"], "left").fillna(0, ["detected"])


def report(test: DataFrame, flagged: DataFrame, chosen: DataFrame, gap: int = GAP, rows: bool = False) -> DataFrame:
    """One row a series: the chosen threshold, event metrics and business metrics; with rows, detections() instead.
    flagged: (series_id, idx), or runs of them (series_id, start_idx, end_idx)."""
    if rows:
        return detections(test, flagged)
    pred, true = E.bridged(E.as_runs(flagged), gap), E.to_events(_true(test), gap)
    matched = once(E.matched(pred, true))
    m = M.event_counts(test.select("series_id").distinct(), matched, true)
    b = M.business_of(test, matched).select("series_id", "fp_per_day", "median_latency_minutes", "duration_days")
    return chosen.join(m, "series_id").join(b, "series_id")


def tuned(test: DataFrame, flagged: DataFrame, ks: list[float], most: float | None = 0.10, gap: int = GAP, final_gap: int | None = None, rows: bool = False) -> DataFrame:
    """Choose each series' threshold on the rows it is judged on, and report. flagged: (series_id, k, idx), or runs of them. final_gap:
    the zeros bridged in the report, where it differs from the sweep's gap."""
    test, flagged = once(test), once(E.as_runs(flagged, ("series_id", "k")))
    swept = M.sweep(test, flagged, _true(test), ks, gap)
    chosen = once(M.best(swept, most))
    final = flagged.join(chosen.select("series_id", F.col("best_k").alias("k")), ["series_id", "k"]).select("series_id", "start_idx", "end_idx")
    return report(test, final, chosen, gap if final_gap is None else final_gap, rows)


def by_rolling_scale(test: DataFrame, final_gap: int | None = None, rows: bool = False) -> DataFrame:
    """Residuals over their deviation in the last 48 rows (where that is 0, over that of all of them), thresholds 3 to 12,
    no bound on the anomaly rate. NaN residuals are missing."""
    known = test.withColumn("resid", F.nanvl("resid", F.lit(None).cast("double")))
    z = F.when(F.col("scale") > 0, F.abs("resid") / F.col("scale"))
    s = once(R.residual_z(known, "resid", "rolling", window=48, train=F.lit(True)).withColumn("z", z))
    return tuned(s, M.runs_above_by_k(s, "z", M.WIDE_GRID, PERSIST), M.WIDE_GRID, None, final_gap=final_gap, rows=rows)


@whole
def kalman(series: DataFrame, train: float = 0.7, fit_rows: int | None = None, rows: bool = False) -> DataFrame:
    """Local level; residuals over their MAD scale, k = 3, persistence 2, events without bridging. The rows have the band of
    3 sample deviations of the training residuals, lower and upper, beside the model's own."""
    left = F.nanvl("train_resid", F.lit(None).cast("double"))
    f = models.local_level_forecast(series, train, fit_rows).withColumn("sigma", F.stddev_samp(left).over(P.by_series()))
    f = f.withColumns({"resid": F.col("value") - F.col("pred_mean"), **P.band(F.col("pred_mean"), F.col("sigma"), 3.0)})
    test = once(_part(f, train))
    flags = R.residual_z(test, "resid", "mad", 3.0).filter("flag = 1").select("series_id", "idx")
    chosen = test.select("series_id").distinct().withColumns({"best_k": F.lit(3.0), "best_f1": F.lit(None).cast("double")})
    return report(test, E.persistent(flags, PERSIST), chosen, 0, rows)


@whole
def bsts(series: DataFrame, train: float = 0.5, periods: tuple[int, ...] = (48, 336), harmonics: int = 10, fit_rows: int | None = None, rows: bool = False) -> DataFrame:
    """Trend and harmonics; residuals less their median; the threshold is chosen on the validation part alone."""
    return validated(after_training(models.bsts_forecast(series, train, periods, harmonics, fit_rows), train), rows=rows)


def after_training(forecast: DataFrame, train: float) -> DataFrame:
    """The rows after the training part with their split, and resid: residuals less their median over both parts."""
    later = P.split(forecast.withColumn("r", F.col("value") - F.col("pred_mean")), train).filter("split != 'Train'")
    return P.centred(later, "r").withColumn("resid", F.col("centred"))


def validated(parts: DataFrame, col: str = "resid", rows: bool = False) -> DataFrame:
    """parts: rows with a split column; rolling state starts anew at the split."""
    parts = once(parts)
    scored = R.rolling_sigma(parts, col, by=("series_id", "split"))
    both = once(M.runs_by_k(scored, col, M.K_GRID, PERSIST, ("series_id", "split")))
    val, test = parts.filter("split = 'Validation'"), parts.filter("split = 'Test'")
    flags = both.filter("split = 'Validation'").drop("split")
    chosen = once(M.best(M.sweep(val, flags, _true(val), M.K_GRID, GAP)))
    final = both.filter("split = 'Test'").join(chosen.select("series_id", F.col("best_k").alias("k")), ["series_id", "k"]).select("series_id", "start_idx", "end_idx")
    return report(test, final, chosen, rows=rows)


@whole
def gaussian_process(series: DataFrame, train: float = 0.5, rows: bool = False) -> DataFrame:
    test = once(_part(models.gp_forecast(series, train).withColumn("resid", F.col("value") - F.col("pred_mean")), train))
    return tuned(test, M.runs_by_k(R.rolling_sigma(test, "resid"), "resid", M.K_GRID, PERSIST), M.K_GRID, rows=rows)


@whole
def lstm(series: DataFrame, train: float = 0.5, epochs: int = 15, rows: bool = False) -> DataFrame:
    """On residuals of the decomposition of the whole series."""
    f = models.lstm_forecast(series, train, epochs=epochs, of="resid").withColumn("resid", F.col("target") - F.col("pred"))
    test = once(_part(f, train))
    return tuned(test, M.runs_by_k(R.rolling_sigma(test, "resid"), "resid", M.K_GRID, PERSIST), M.K_GRID, rows=rows)


@whole
def hybrid_scores(series: DataFrame, train: float = 0.5, epochs: int = 10) -> DataFrame:
    """score_stl, score_gp (0 in the training part), score_lstm and their mean, combined_score."""
    d = once(models.decompose(series))
    return combined(d, models.gp_forecast(series, train), models.lstm_forecast(series, train, epochs=epochs, of="resid"))


def combined(decomposed: DataFrame, process: DataFrame, network: DataFrame) -> DataFrame:
    """hybrid_scores() from rows with resid, with pred_mean and pred_std, and with target and pred."""
    key = ["series_id", "idx"]
    sized = decomposed.join(P.mad_scale(decomposed, "resid"), "series_id")
    a = sized.select("series_id", "idx", "ts", "value", "is_anomaly", (F.abs("resid") / (F.col("mad_sigma") + 1e-9)).alias("score_stl"))
    g = process.select(*key, P.finite(F.abs(F.col("value") - F.col("pred_mean")) / (F.col("pred_std") + 1e-9)).alias("score_gp"))
    f = network.withColumn("left", F.nanvl(F.col("target") - F.col("pred"), F.lit(None).cast("double")))
    f = R.rolling_score(f, "left").select(*key, P.finite(F.col("score")).alias("score_lstm"))
    s = a.join(g, key, "left").join(f, key, "left")
    return s.withColumn("combined_score", P.ensemble({"score_stl": 1.0, "score_gp": 1.0, "score_lstm": 1.0}))


@whole
def hybrid(series: DataFrame, train: float = 0.5, epochs: int = 10, rows: bool = False) -> DataFrame:
    test = once(_part(hybrid_scores(series, train, epochs), train))
    return tuned(test, M.runs_above_by_k(test, "combined_score", M.K_GRID, PERSIST), M.K_GRID, rows=rows)


@whole
def bsts_dummy(series: DataFrame, train: float = 0.5, season: int = 48, fit_rows: int | None = None) -> DataFrame:
    """Trend and a dummy season; thresholds are compared on bridged events, the report's events aren't bridged."""
    f = models.structural_forecast(series, train, state_space.Structural(dummy=season), fit_rows)
    return by_rolling_scale(_part(f.withColumn("resid", F.col("value") - F.col("pred_mean")), train), final_gap=0)


@whole
def bsts_enhanced(series: DataFrame, train: float = 0.5, periods: tuple[int, ...] = (48, 336), harmonics: int = 10, fit_rows: int | None = None) -> DataFrame:
    """Trend and harmonics of a day and a week, without a validation part."""
    f = models.bsts_forecast(series, train, periods, harmonics, fit_rows)
    return by_rolling_scale(_part(f.withColumn("resid", F.col("value") - F.col("pred_mean")), train))


@whole
def lstm_raw(series: DataFrame, train: float = 0.5, epochs: int = 20) -> DataFrame:
    """One layer on the values themselves, scaled by the training part."""
    f = models.lstm_forecast(series, train, layers=1, epochs=epochs, scale="train")
    return by_rolling_scale(_part(f.withColumn("resid", F.col("target") - F.col("pred")), train))


@whole
def gaussian_process_simple(series: DataFrame, train: float = 0.5) -> DataFrame:
    """One season; residuals over the predicted deviation of their own row, events bridged over one row, no bound on the
    anomaly rate."""
    f = models.gp_forecast(series, train, kernel=models.simple_kernel(), restarts=3)
    test = once(_part(f.withColumn("z", F.abs(F.col("value") - F.col("pred_mean")) / F.col("pred_std")), train))
    return tuned(test, M.runs_above_by_k(test, "z", M.K_GRID, PERSIST), M.K_GRID, None, gap=1)


def changepoints(series: DataFrame, hazard: float = 0.01, over: float = 0.5) -> DataFrame:
    """Each row's chance of a changepoint, the likeliest run length, and whether the chance is over a bound."""
    return models.run_lengths(series, hazard).withColumn("highlight", (F.col("cp_prob") > over).cast("int"))


@whole
def stl_baseline(series: DataFrame) -> DataFrame:
    """Residuals of the decomposition over their rolling deviation, thresholds 3 to 12, no bound on the anomaly rate."""
    d = models.decompose(series)
    s = once(R.backfilled(R.rolling_stats(d, "resid"), "std_roll").withColumn("z", F.abs("resid") / F.col("std_roll")))
    return tuned(s, M.runs_above_by_k(s, "z", M.WIDE_GRID, PERSIST), M.WIDE_GRID, None)


COUNTS = ("tp", "fp", "fn", "n_true_events", "n_pred_events")
REPORT = ("best_k", "best_f1", *COUNTS, "precision", "recall", "f1", "fp_per_day", "median_latency_minutes", "duration_days")


def _decomposed(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return stl(y)[2], np.full(len(y), np.nan)


def _first_two(y: np.ndarray, work, **settings) -> tuple[np.ndarray, np.ndarray]:
    return tuple(work(y, **settings)[:2])


def benchmark_models(train: float = 0.5) -> dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """The models behind the four detectors; HYBRID takes the process that GP takes, and a network of its own."""
    on_residuals = {"train": train, "length": 48, "hidden": 64, "layers": 2, "of": "resid", "scale": "full"}
    return {
        "STL": _decomposed,
        "BSTS": partial(_first_two, work=models.structural, train=train, model=state_space.Structural(periods=(48, 336))),
        "GP": partial(_first_two, work=models.process, train=train, rows=1000, kernel=gaussian.Kernel(models.SEASONS), restarts=1),
        "LSTM": partial(_first_two, work=models.network, epochs=15, **on_residuals),
        "LSTM_SHORT": partial(_first_two, work=models.network, epochs=10, **on_residuals),
    }


#: The detectors of the benchmark and the models that each needs.
DETECTORS = {"BSTS": ("BSTS",), "GP": ("GP",), "LSTM": ("LSTM",), "HYBRID": ("STL", "GP", "LSTM_SHORT")}
_SEP = "\x01"


def _judged(fits: DataFrame, train: float) -> DataFrame:
    """(series_id, split, idx, ts, value, is_anomaly, resid) of all detectors from the models' rows, in one frame whose
    series_id has the detector's name before it. Only BSTS has validation rows."""
    of = lambda model, a, b: fits.filter((F.col("model") == model) & F.col("idx").isNotNull()).withColumnsRenamed({"a": a, "b": b})
    gp = of("GP", "pred_mean", "pred_std")
    failed = fits.filter(F.col("idx").isNull() & F.col("model").isin(*DETECTORS["HYBRID"])).select("series_id").distinct()
    sound = of("STL", "resid", "none").join(failed, "series_id", "left_anti")
    parts = {
        "BSTS": after_training(of("BSTS", "pred_mean", "pred_std"), train),
        "GP": _part(gp.withColumn("resid", F.col("value") - F.col("pred_mean")), train),
        "LSTM": _part(of("LSTM", "target", "pred").withColumn("resid", F.col("target") - F.col("pred")), train),
        "HYBRID": _part(combined(sound, gp, of("LSTM_SHORT", "target", "pred")).withColumn("resid", F.col("combined_score")), train),
    }
    named = lambda name, rows: rows.select(F.concat(F.lit(name + _SEP), "series_id").alias("series_id"), "split" if name == "BSTS" else F.lit("Test").alias("split"), "idx", "ts", "value", "is_anomaly", "resid")
    return reduce(DataFrame.unionByName, [named(name, rows) for name, rows in parts.items()])


@whole
def benchmark(series: DataFrame, train: float = 0.5, items: dict[str, Callable] | None = None) -> DataFrame:
    """BSTS, GP, LSTM and HYBRID on every series: Model, series_id, the report's columns and error. Models are fitted as items
    of work of their own, in one job; thresholds of all detectors are swept together. A model that fails on a series leaves
    nulls and its error in the rows of the detectors that need it there, and all others stand. items: other models."""
    path = staging(series.sparkSession)
    fits = saved(models.fits(series, items or benchmark_models(train)), f"{path}/fits")
    scored = saved(R.rolling_sigma(_judged(fits, train), "resid", by=("series_id", "split")), f"{path}/scored")
    is_model = lambda name: F.col("series_id").startswith(name + _SEP)
    tune = scored.filter(F.col("split") == F.when(is_model("BSTS"), "Validation").otherwise("Test"))
    chosen = saved(M.best(M.sweep_series(tune, "resid", M.K_GRID, PERSIST, GAP, is_model("HYBRID"))), f"{path}/chosen")
    test = scored.filter("split = 'Test'")
    flags = test.join(chosen, "series_id").filter(M.over("resid", F.col("best_k"), is_model("HYBRID"))).select("series_id", "idx")
    final = saved(E.persistent(flags, PERSIST), f"{path}/flags")
    typed = [F.col(c).cast("long" if c in COUNTS else "double").alias(c) for c in REPORT]
    found = report(test, final, chosen).select(F.substring_index("series_id", _SEP, 1).alias("Model"), F.substring_index("series_id", _SEP, -1).alias("series_id"), *typed)
    needs = F.explode(F.array(*[F.struct(F.lit(d).alias("Model"), F.lit(m).alias("lost")) for d, ms in DETECTORS.items() for m in ms]))
    lost = fits.filter("idx is null").select("series_id", F.col("model").alias("lost"), "error")
    asked = series.select("series_id").distinct().select("series_id", needs.alias("x")).select("series_id", "x.*")
    cells = asked.join(lost, ["series_id", "lost"], "left").groupBy("Model", "series_id").agg(F.min("error").alias("error"))
    return cells.join(found, ["Model", "series_id"], "left").select("Model", "series_id", *REPORT, "error")


def ranked(reports: DataFrame) -> DataFrame:
    """The leaderboard of benchmark()'s rows; a failed detector's have nulls."""
    level = F.when(F.col("f1").isNotNull(), F.struct("precision", "recall", "f1", *COUNTS))
    business = F.when(F.col("duration_days").isNotNull(), F.struct("fp_per_day", "median_latency_minutes", "duration_days"))
    return results.leaderboard(reports.select("Model", F.col("series_id").alias("Dataset"), level.alias("event_level"), business.alias("business"), "fp_per_day", "median_latency_minutes"))
