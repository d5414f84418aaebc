"""Models on series, one group each: decomposition, forecasts, scores. Rows: (series_id, idx, ts, value, is_anomaly).

A sequential model needs its series whole; the task's memory is that series' rows. Series are independent, so the cluster
works on as many as it has cores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import changepoints, gaussian_process, lstm, state_space
from tidewatch.functions.stl import stl
from tidewatch.session import ship

ROW = "series_id string, idx long, ts timestamp_ntz, value double, is_anomaly int"
#: Partitions of model work: at least so many, and so many for each of the session's shuffle partitions.
LEAST_PARTS, SPREAD = 256, 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by ranges of keys over a fixed number of partitions. A model takes seconds for a series of a few kilobytes, so
    partitions mustn't be merged by their bytes, as adaptive execution does with those it made itself, and few items mustn't
    meet in one by their hashes: where there are fewer keys than partitions, ranges give each its own."""
    ship(rows.sparkSession)
    n = SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(max(n, LEAST_PARTS), *keys)


def _each(series: DataFrame, columns: str, work) -> DataFrame:
    """work(values) returns arrays for the columns; null values of a column are NaN there."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        for name, values in zip(names, work(f["value"].to_numpy(float)), strict=True):
            f[name] = pd.Series(values, index=f.index)
        return f

    kept = series.select(*[c.split()[0] for c in ROW.split(", ")])
    return dealt(kept, "series_id").groupBy("series_id").applyInPandas(run, f"{ROW}, {columns}")


def fits(series: DataFrame, items: dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(model, *series' columns, a, b, error): every model on every series, in one job. A pair of a series and a model is an
    item of work on its own: one that fails gives one row, with the error's text and null idx, and the others go on.

    items: functions of the values that return two arrays as long (a, b)."""
    cells = series.select(*[c.split()[0] for c in ROW.split(", ")], F.explode(F.array(*[F.lit(m) for m in items])).alias("model"))

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        try:
            a, b = items[key[1]](f["value"].to_numpy(float))
            return f.assign(a=a, b=b, error=None)
        except Exception as error:  # whatever a model raises
            lost = f.iloc[:1].assign(a=np.nan, b=np.nan, error=f"{type(error).__name__}: {error}")
            return lost.astype({"idx": "Int64"}).assign(idx=pd.array([None], "Int64"))

    return dealt(cells, "series_id", "model").groupBy("series_id", "model").applyInPandas(run, f"{ROW}, model string, a double, b double, error string")


def decompose(series: DataFrame, period: int = 48, robust: bool = True) -> DataFrame:
    return _each(series, "trend double, seasonal double, resid double", lambda y: stl(y, period, robust=robust))


def padded(n: int, *parts: np.ndarray) -> list[np.ndarray]:
    """Each part at the end of n places, NaN before."""
    return [np.concatenate([np.full(n - len(p), np.nan), p]) for p in parts]


def structural(y: np.ndarray, train: float, model: state_space.Structural, fit_rows: int | None = None) -> list[np.ndarray]:
    """Mean, deviation, band of 95 % after the training part, and the training part's one-step residuals."""
    end = int(len(y) * train)
    variances, left = model.fit(y[:end], window=fit_rows), []
    model.filter(y[:end], variances, left)
    mean, sd = model.forecast(y[:end], variances, len(y) - end)
    return [*padded(len(y), mean, sd, mean - 1.959963984540054 * sd, mean + 1.959963984540054 * sd), np.append(left, np.full(len(y) - end, np.nan))]


def process(y: np.ndarray, train: float, rows: int, kernel: gaussian_process.Kernel, restarts: int) -> list[np.ndarray]:
    """Mean and deviation after the training part, of a process on that part's last rows."""
    end = int(len(y) * train)
    part = y[max(0, end - rows) : end]
    p = gaussian_process.fit(kernel, part, restarts)
    return padded(len(y), *gaussian_process.predict(p, part, np.arange(len(part), len(part) + len(y) - end)))


def network(y: np.ndarray, train: float, length: int, hidden: int, layers: int, epochs: int, of: str, scale: str) -> list[np.ndarray]:
    """What is predicted, and its prediction one step ahead."""
    target = stl(y)[2] if of == "resid" else y
    end = int(len(y) * train)
    part = target[:end] if scale == "train" else target
    mu, sd = part.mean(), part.std() or 1.0
    z = (target - mu) / sd
    net = lstm.Network(hidden, layers, kind=np.float32)
    net.train(*lstm.windows(z[:end], length), epochs=epochs)
    return [target, *padded(len(y), net.predict(lstm.windows(z, length)[0]) * sd + mu)]


def structural_forecast(series: DataFrame, train: float, model: state_space.Structural, fit_rows: int | None = None) -> DataFrame:
    """pred_mean, pred_std, pred_lower, pred_upper from the end of the training part on, without updates, and train_resid,
    the training part's one-step residuals. fit_rows: the last rows of the training part that give the variances, all of
    them where it is None."""
    columns = "pred_mean double, pred_std double, pred_lower double, pred_upper double, train_resid double"
    return _each(series, columns, partial(structural, train=train, model=model, fit_rows=fit_rows))


def local_level_forecast(series: DataFrame, train: float = 0.7, fit_rows: int | None = None) -> DataFrame:
    return structural_forecast(series, train, state_space.Structural(slope=False), fit_rows)


def bsts_forecast(series: DataFrame, train: float = 0.5, periods: tuple[int, ...] = (48, 336), harmonics: int = 10, fit_rows: int | None = None) -> DataFrame:
    return structural_forecast(series, train, state_space.Structural(periods=periods, harmonics=harmonics), fit_rows)


#: A day and a week of half hours, and the bounds of each; and the kernel of one season, whose other parameters are as good
#: as unbounded.
SEASONS = ((48.0, 47.5, 48.5), (336.0, 335.0, 337.0))


def simple_kernel() -> gaussian_process.Kernel:
    return gaussian_process.Kernel(((48.0, 47.0, 49.0),), rbf=(50.0, *gaussian_process.WIDE), amplitudes=gaussian_process.WIDE)


def gp_forecast(series: DataFrame, train: float = 0.5, rows: int = 1000, kernel: gaussian_process.Kernel | None = None, restarts: int = 1) -> DataFrame:
    """pred_mean and pred_std after the training part, of whose last rows the process is fitted."""
    kernel = kernel or gaussian_process.Kernel(SEASONS)
    return _each(series, "pred_mean double, pred_std double", partial(process, train=train, rows=rows, kernel=kernel, restarts=restarts))


def lstm_forecast(series: DataFrame, train: float = 0.5, length: int = 48, hidden: int = 64, layers: int = 2, epochs: int = 10, of: str = "value", scale: str = "full") -> DataFrame:
    """pred: one step ahead from the length values before, null for the first; trained on the training part. scale: full or
    train, the rows that give mean and deviation. of='resid' works on the decomposition's residuals."""
    return _each(series, "target double, pred double", partial(network, train=train, length=length, hidden=hidden, layers=layers, epochs=epochs, of=of, scale=scale))


#: Mass of the longest run lengths that posteriors leave out: what bounds their length, and with it a series' work.
TAIL = 1e-12


def _standard(y: np.ndarray, eps: float) -> np.ndarray:
    return (y - y.mean()) / (y.std() + (1e-9 if eps else 0.0) or 1.0)


def run_length_matrix(series: DataFrame, hazard: float = 0.01, eps: float = 1e-9, least: float = 0.0, tail: float = 0.0) -> DataFrame:
    """(series_id, idx, run_length, prob): the posterior over run lengths after each value, where it is at least least; all
    of it by default, so that a series of n rows gives n * (n + 3) / 2. tail: mass of the longest that may be left out."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        runs, parts = changepoints.RunLengths(hazard, eps, tail), []
        for i, v in zip(f["idx"], _standard(f["value"].to_numpy(float), eps), strict=True):
            r = runs.update(v)
            at = np.flatnonzero(r >= least)
            parts.append(pd.DataFrame({"idx": i, "run_length": at, "prob": r[at]}))
        return pd.concat(parts).assign(series_id=f["series_id"].iloc[0])[["series_id", "idx", "run_length", "prob"]]

    return dealt(series.select("series_id", "idx", "value"), "series_id").groupBy("series_id").applyInPandas(run, "series_id string, idx long, run_length long, prob double")


def run_lengths(series: DataFrame, hazard: float = 0.01, eps: float = 0.0, tail: float = TAIL) -> DataFrame:
    """cp_prob (the hazard itself, when eps is 0) and map_run_length of the standardised series."""

    def work(y):
        runs = changepoints.RunLengths(hazard, eps, tail)
        out = [(r[0], int(r.argmax())) for r in map(runs.update, _standard(y, eps))]
        return [np.array([a for a, _ in out]), np.array([b for _, b in out], float)]

    return _each(series, "cp_prob double, map_run_length double", work)


def level_filter(series: DataFrame, q: float = 0.1, r: float = 1.0) -> DataFrame:
    return _each(series, "level double, level_var double", lambda y: state_space.local_level(y, q, r))
