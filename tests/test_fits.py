"""Fitted models against dense algebra, differences and many random searches; the benchmark's items of work."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import line
from tidewatch import session as sessions
from tidewatch.functions import gaussian_process as gaussian
from tidewatch.functions.optimise import minimise
from tidewatch.functions.state_space import Structural
from tidewatch.plans import models, pipelines


def season(n=180, k=0):
    r, t = np.random.default_rng(k), np.arange(n)
    return 0.05 * t + 3 * np.sin(t * 2 * np.pi / 12) + r.normal(size=n).cumsum() * 0.3 + r.normal(size=n)


MODELS = [Structural(slope=False), Structural(), Structural(periods=(12,), harmonics=2), Structural(periods=(12,), dummy=5, harmonics=1), Structural(slope=False, dummy=7)]


def plain_likelihood(model, y, variances):
    """The density of the values after the first size ones, given these: full covariances of all values, no recursion."""
    n, size = len(y), model.size
    powers = [np.eye(size)]
    for _ in range(n):
        powers.append(model.T @ powers[-1])
    spread = [np.eye(size) * 1e6]
    for _ in range(n - 1):
        spread.append(model.T @ spread[-1] @ model.T.T + np.diag(model.q(variances)))
    cov = np.empty((n, n))
    for i in range(n):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = model.Z @ powers[i - j] @ spread[j] @ model.Z
    cov += variances[0] * np.eye(n)

    def density(m):
        sign, log = np.linalg.slogdet(cov[:m, :m])
        return -0.5 * (log + y[:m] @ np.linalg.solve(cov[:m, :m], y[:m]) + m * np.log(2 * np.pi))

    return density(n) - density(size)


@pytest.mark.parametrize("model", MODELS)
def test_likelihood_and_gradient(model):
    y = season(60)
    variances = np.exp(np.random.default_rng(1).normal(0, 1, model.kinds))
    value, slope = model.likelihood(y, variances)
    assert value == pytest.approx(plain_likelihood(model, y, variances), abs=1e-4)
    assert value == pytest.approx(model.filter(y, variances)[0], abs=1e-5)
    for i in range(model.kinds):
        away = np.zeros(model.kinds)
        away[i] = 1e-4 * variances[i]
        up, down = (model.likelihood(y, variances + s * away)[0] for s in (1, -1))
        assert slope[i] == pytest.approx((up - down) / (2 * away[i]), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("model, k", [(Structural(slope=False), 2), (Structural(), 1), (Structural(periods=(12,), harmonics=1), 0)])
def test_no_random_search_finds_a_better_fit(model, k):
    r = np.random.default_rng(k)
    y = [season(100, k), 5 * np.sin(np.arange(100) / 2) + r.normal(size=100), np.maximum(0, r.normal(size=100)) ** 2][k]
    n, scale = len(y) - model.size, y.var()

    def work(logs):
        value, slope = model.likelihood(y, np.exp(logs))
        return -value / n, -slope * np.exp(logs) / n

    low, high = np.full(model.kinds, np.log(scale) - 25), np.full(model.kinds, np.log(scale) + 25)
    best = max(-n * minimise(work, np.log(scale) + r.uniform(-12, 1, model.kinds), low, high)[0] for _ in range(20))
    assert model.filter(y, model.fit(y))[0] > best - 0.01


def test_minimum_at_bounds():
    bowl = lambda x: (((x - [3.0, -1.0]) ** 2 * [1.0, 100.0]).sum(), 2 * (x - [3.0, -1.0]) * [1.0, 100.0])
    assert minimise(bowl, np.zeros(2), np.full(2, -9.0), np.full(2, 9.0))[1] == pytest.approx([3, -1], abs=1e-5)
    assert minimise(bowl, np.zeros(2), np.zeros(2), np.full(2, 2.0))[1] == pytest.approx([2, 0])
    valley = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert minimise(valley, np.array([-1.2, 1.0]), np.full(2, -9.0), np.full(2, 9.0))[1] == pytest.approx([1, 1], abs=1e-4)


def dense(p, n):
    d = (np.arange(n)[:, None] - np.arange(n)).astype(float)
    return gaussian.Kernel.smooth(p, d) + p[-1] * np.eye(n)


def dense_evidence(p, y):
    sign, log = np.linalg.slogdet(dense(p, len(y)))
    return -0.5 * (log + y @ np.linalg.solve(dense(p, len(y)), y) + len(y) * np.log(2 * np.pi))


def test_evidence_gradient_and_prediction():
    kernel = gaussian.Kernel(((12.0, 11.5, 12.5), (40.0, 39.0, 41.0)))
    y = season(120)
    z = (y - y.mean()) / y.std()
    for p in (np.array(kernel.start), np.array([2.0, 15.0, 0.5, 0.7, 12.2, 0.3, 2.0, 39.5, 0.2])):
        value, slope = gaussian.evidence(p, z)
        assert value == pytest.approx(dense_evidence(p, z), rel=1e-9)
        for i in range(len(p)):
            up, down = p.copy(), p.copy()
            up[i] *= np.exp(1e-5)
            down[i] *= np.exp(-1e-5)
            assert slope[i] == pytest.approx((dense_evidence(up, z) - dense_evidence(down, z)) / 2e-5, rel=1e-4, abs=1e-4)
        at = np.arange(120, 150)
        mean, sd = gaussian.predict(p, y, at)
        k = gaussian.Kernel.smooth(p, (at[:, None] - np.arange(120)).astype(float))
        assert mean == pytest.approx(k @ np.linalg.solve(dense(p, 120), z) * y.std() + y.mean())
        assert sd == pytest.approx(np.sqrt(p[0] + p[2] + p[5] + p[-1] - (k * np.linalg.solve(dense(p, 120), k.T).T).sum(1)) * y.std())


@pytest.mark.parametrize("kernel", [gaussian.Kernel(((12.0, 11.5, 12.5),)), models.simple_kernel()])
def test_no_grid_has_more_evidence(kernel):
    y = season(100, 4)
    z = (y - y.mean()) / y.std()
    found = gaussian.fit(kernel, y, restarts=2)
    assert (found >= np.array(kernel.low) * 0.999).all() and (found <= np.array(kernel.high) * 1.001).all()
    best = gaussian.evidence(found, z)[0]
    rng = np.random.default_rng(3)
    grid = np.exp(rng.uniform(np.log(kernel.low), np.log(kernel.high), (100, len(found))))
    near = found * np.exp(rng.normal(0, 0.3, (100, len(found))))
    for p in [*grid, *np.clip(near, kernel.low, kernel.high)]:
        assert gaussian.evidence(p, z)[0] <= best + 1e-3


def test_simple_kernel_is_bounded_by_its_period_alone():
    kernel = models.simple_kernel()
    assert list(zip(kernel.low, kernel.high)) == [gaussian.WIDE] * 4 + [(47.0, 49.0), gaussian.WIDE]


def test_short_series_have_a_fit():
    for y in (np.zeros(0), np.zeros(1), np.ones(5)):
        assert len(Structural().fit(y)) == 3
        mean, sd = gaussian.predict(gaussian.fit(gaussian.Kernel(()), y), y, np.arange(3) + len(y))
        assert np.isfinite(mean).all() and np.isfinite(sd).all()


def marked(spark, names):
    rows = None
    for k, name in enumerate(names):
        r = np.random.default_rng(k)
        values = 10 + np.sin(np.arange(240) / 5) + r.normal(0, 0.2, 240)
        values[[150, 151, 152, 200, 201]] += 8
        one = line(spark, values, name).withColumn("is_anomaly", F.col("idx").isin(150, 151, 200).cast("int"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def test_a_broken_model_loses_only_its_own_cell(spark):
    def plain(y):
        return np.full(len(y), 10.0), np.ones(len(y))

    def broken(y):
        if y[0] == bad:
            raise FloatingPointError("no model")
        return plain(y)

    rows = marked(spark, ["a", "b", "c"])
    bad = rows.filter("series_id = 'b' and idx = 0").first().value
    items = {"STL": lambda y: (y - 10, np.full(len(y), np.nan)), "BSTS": plain, "GP": plain, "LSTM": broken, "LSTM_SHORT": plain}
    got = {(r.Model, r.series_id): r for r in pipelines.benchmark(rows, items=items).collect()}
    assert set(got) == {(m, s) for m in pipelines.DETECTORS for s in "abc"}
    lost = {k for k, r in got.items() if r.error}
    assert lost == {("LSTM", "b")} and got["LSTM", "b"].error == "FloatingPointError: no model" and got["LSTM", "b"].f1 is None
    assert all(r.f1 is not None for k, r in got.items() if k not in lost)
    assert got["GP", "a"].tp == 2 and got["GP", "a"].n_true_events == 2
    items |= {"LSTM": plain, "GP": broken}
    got = {(r.Model, r.series_id): r for r in pipelines.benchmark(rows, items=items).collect()}
    assert {k for k, r in got.items() if r.error} == {("GP", "b"), ("HYBRID", "b")} == {k for k, r in got.items() if r.f1 is None}
    board = pipelines.ranked(pipelines.benchmark(rows, items=items)).collect()
    assert len(board) == 12 and sum(r.Event_F1 is None for r in board) == 2


def test_benchmark_equals_single_detectors(spark):
    """The shared sweep against each detector's own plan, with cheap forecasts in place of the models."""
    rows = marked(spark, ["a", "b"])
    items = {"STL": lambda y: (y - 10, y * np.nan), "BSTS": lambda y: (10 + 0 * y, y), "GP": lambda y: (10 + 0 * y, 1 + 0 * y), "LSTM": lambda y: (y, 10 + 0 * y), "LSTM_SHORT": lambda y: (y - 10, 0 * y)}
    got = {(r.Model, r.series_id): r for r in pipelines.benchmark(rows, items=items).collect()}
    forecast = rows.withColumns({"pred_mean": F.lit(10.0), "pred_std": F.lit(1.0), "target": F.col("value"), "pred": F.lit(10.0)})
    own = {"BSTS": pipelines.validated(pipelines.after_training(forecast, 0.5))}
    test = forecast.filter("idx >= 120").withColumn("resid", F.col("value") - 10)
    own["GP"] = pipelines.tuned(test, pipelines.M.flagged_by_k(pipelines.R.rolling_sigma(test, "resid"), "resid", pipelines.M.K_GRID, 2), pipelines.M.K_GRID)
    mixed = pipelines.combined(rows.withColumn("resid", F.col("value") - 10), forecast, rows.withColumns({"target": F.col("value") - 10, "pred": F.lit(0.0)})).filter("idx >= 120")
    own["HYBRID"] = pipelines.tuned(mixed, pipelines.M.above_by_k(mixed, "combined_score", pipelines.M.K_GRID, 2), pipelines.M.K_GRID)
    for name, report in own.items():
        for r in report.collect():
            for c in pipelines.REPORT:
                assert got[name, r.series_id][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]), (name, c)


def test_nothing_stays_cached(spark):
    rows = marked(spark, ["a"])
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    out = pipelines.kalman(rows)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before and not pipelines._KEPT and out.count() == 1
    with pytest.raises(ZeroDivisionError):
        with pipelines.kept():
            pipelines.once(rows).count()
            raise ZeroDivisionError
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before and not pipelines._KEPT


def test_scratch_goes_even_when_work_fails(spark):
    with pytest.raises(ZeroDivisionError), sessions.scratch(spark):
        path = sessions.staging(spark)
        sessions.saved(spark.range(3), path)
        raise ZeroDivisionError
    assert not os.path.exists(path.removeprefix("file://")) and path not in sessions._OPEN


def test_models_run_without_the_package_on_the_workers_path(tmp_path):
    """The driver alone knows where the package is; its working directory is elsewhere."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
        import sys
        sys.path.insert(0, {top!r})
        from tidewatch.plans import queries
        from tidewatch.session import session
        spark = session("local[2]", partitions=2)
        print("rows", queries.local_level_filter(spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7195" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("chunk", [48, 97, 1000])
def test_chunks_of_a_series_see_their_whole_windows(spark, chunk):
    from tidewatch.operators import diagnostics as D
    from tidewatch.operators import rolling as R

    rng = np.random.default_rng(0)
    values = rng.normal(size=1000)
    rows = line(spark, values, "a").unionByName(line(spark, values[:7], "b")).withColumn("value", F.when(F.col("idx") % 100 != 60, F.col("value")))
    whole = R.rolling_stats(rows).orderBy("series_id", "idx").toPandas()
    parts = R.rolling_stats(rows, chunk=chunk).orderBy("series_id", "idx").toPandas()
    assert list(parts.columns) == list(whole.columns) and len(parts) == 1007
    for c in ("mean_roll", "std_roll"):
        assert np.allclose(parts[c], whole[c], equal_nan=True, rtol=1e-12)
    d = np.where(np.arange(1000) % 100 != 60, values, np.nan)
    d = np.nan_to_num(d - np.nanmean(d))
    want = [(d[: 1000 - h] * d[h:]).sum() / (d * d).sum() for h in range(51)]
    got = {(r.series_id, r.lag): r.acf for r in D.acf(rows, chunk=chunk).collect()}
    assert [got["a", h] for h in range(51)] == pytest.approx(want, abs=1e-12)
    assert all(got["b", h] == 0 for h in range(7, 51)) and got["b", 0] == 1
