"""Worked examples for the operators, and properties of the models."""

import datetime as dt
import json
from math import lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import gaussian_process, state_space
from tidewatch.functions.changepoints import RunLengths, _log_ratio
from tidewatch.functions.stl import stl
from tidewatch.operators import diagnostics as D
from tidewatch.operators import events as E
from tidewatch.operators import metrics as M
from tidewatch.operators import rolling as R
from tidewatch.plans import models, pipelines
from tidewatch.plans import queries as plans
from tidewatch.sources import results
from tidewatch.sources import series as S

START = dt.datetime(2024, 1, 1)


def flags(spark, bits, series="a"):
    return spark.createDataFrame([(series, i) for i, b in enumerate(bits) if b], "series_id string, idx long")


def line(spark, values, series="a"):
    rows = [(series, i, START + dt.timedelta(minutes=30 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, idx long, ts timestamp_ntz, value double")


def spans(df):
    return sorted((r.start_idx, r.end_idx) for r in df.collect())


BITS = [1, 0, 1, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("gap,expected", [(0, [(0, 0), (2, 3), (7, 7)]), (1, [(0, 3), (7, 7)]), (3, [(0, 7)])])
def test_event_merge(spark, gap, expected):
    assert spans(E.to_events(flags(spark, BITS), gap)) == expected


def test_persistence(spark):
    keep = lambda p: sorted(r.idx for r in E.persistent(flags(spark, BITS), p).collect())
    assert keep(2) == [2, 3]
    assert keep(1) == [0, 2, 3, 7]


def test_event_metrics_count_each_side(spark):
    cases = spark.createDataFrame([("a",)], "series_id string")
    true, pred = E.to_events(flags(spark, [0, 1, 1, 0, 0, 0, 0, 1, 1, 0])), E.to_events(flags(spark, [0, 0, 1, 0, 0, 1, 0, 0, 0, 0]))
    m = M.event_level(cases, pred, true).first()
    assert (m.tp, m.fp, m.fn) == (1, 1, 1) and abs(m.f1 - 0.5) < 1e-6
    one = M.event_level(cases, E.to_events(flags(spark, [1] * 6)), E.to_events(flags(spark, [1, 0, 0, 0, 0, 1]))).first()
    assert (one.tp, one.fp, one.fn, one.n_true_events) == (1, 0, 0, 2)


def test_latency_and_span(spark):
    s = line(spark, range(10))
    b = M.business(s, E.to_events(flags(spark, [0, 0, 0, 1, 1, 1])), E.to_events(flags(spark, [0, 0, 0, 0, 0, 1, 1]))).first()
    assert b.median_latency_minutes == -60 and b.fp_count == 0
    none = M.business(s, E.to_events(flags(spark, [1])), E.to_events(flags(spark, [0, 0, 1]))).first()
    assert none.median_latency_minutes is None and none.fp_per_day == pytest.approx(1 / (9 / 48))


@pytest.mark.parametrize("minutes,width,expected", [(120, 1, [3, 4, 5]), (135, 1, [4, 5, 6]), (6000, 1, [9]), (-60, 1, [0, 1]), (6000, 0, [])])
def test_label_windows(spark, minutes, width, expected):
    labels = spark.createDataFrame([("a", START + dt.timedelta(minutes=minutes))], "series_id string, label_ts timestamp_ntz")
    marked = E.mark(line(spark, range(10)), labels, width)
    assert sorted(r.idx for r in marked.filter("is_anomaly = 1").collect()) == expected


def test_rolling_sigma_is_capped(spark):
    values = np.zeros(200)
    values[100] = 1e9
    scored = R.rolling_sigma(line(spark, values))
    hit = lambda k: [r.idx for r in scored.filter(R.exceeds("value", F.lit(k))).collect()]
    assert hit(6.5) == [100] and hit(7.0) == []
    assert R.rolling_sigma(line(spark, [3.0] * 60)).filter(R.exceeds("value", F.lit(0.1))).count() == 0


def test_best_threshold_rules(spark):
    rows = [("a", 2.0, 0.0, 0.05), ("a", 2.5, 0.0, 0.01), ("b", 2.0, 0.9, 0.5), ("c", 2.0, 0.3, 0.2), ("c", 2.5, 0.2, 0.1), ("c", 3.0, 0.2, 0.0)]
    best = {r.series_id: (r.best_k, r.best_f1) for r in M.best(spark.createDataFrame(rows, "series_id string, k double, f1 double, anomaly_rate double")).collect()}
    assert best == {"a": (2.0, 0.0), "b": (3.0, None), "c": (2.5, 0.2)}


def test_report_may_bridge_less_than_the_sweep(spark):
    values = np.where(np.arange(200) % 2, 1.0, -1.0)
    values[[100, 101, 104, 105]] = 1e3
    rows = line(spark, values).withColumn("is_anomaly", F.col("idx").isin(100, 101).cast("int")).withColumn("resid", F.col("value"))
    bridged, apart = pipelines.by_rolling_scale(rows).first(), pipelines.by_rolling_scale(rows, final_gap=0).first()
    assert (bridged.best_k, bridged.n_pred_events, bridged.fp) == (3.0, 1, 0)
    assert (apart.best_k, apart.n_pred_events, apart.fp) == (3.0, 2, 1)


def test_pr_auc(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.35, 1), ("a", 0.8, 1)]
    curve = D.pr_curve(spark.createDataFrame(rows, "series_id string, score double, is_anomaly int"))
    assert D.pr_auc(curve).first().auc == pytest.approx(0.791667, abs=1e-6)


def test_csv_labels_and_metrics_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("when,count\n2024-01-01 00:30:00,2\n2024-01-01 00:00:00,1\n")
    got = S.read_csv(spark, str(tmp_path / "one.csv")).orderBy("idx").collect()
    assert [(r.series_id, r.idx, r.value) for r in got] == [("one.csv", 0, 1.0), ("one.csv", 1, 2.0)]
    (tmp_path / "two.csv").write_text("value,note,timestamp\n3,x,2024-01-01 01:00:00\n")
    (tmp_path / "three.csv").write_text("a,b\n2024-01-01 02:00:00,4\n")
    got = S.read_csv(spark, f"{tmp_path}/*.csv").filter("idx = 0").collect()
    assert sorted((r.series_id, r.ts.hour, r.value) for r in got) == [("one.csv", 0, 1.0), ("three.csv", 2, 4.0), ("two.csv", 1, 3.0)]
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(Exception, match="bad.csv"):
        S.read_csv(spark, f"{tmp_path}/*.csv").collect()
    (tmp_path / "e" / "bsts").mkdir(parents=True)
    (tmp_path / "e" / "bsts" / "cv_results.json").write_text('[{"f1": 0.5, "fp_per_day": 1, "latency": null}, {"f1": 0.7, "fp_per_day": 3, "latency": 4}]')
    assert [tuple(r) for r in results.cv_summary(results.scan_folds(spark, str(tmp_path / "e"))).collect()] == [("bsts", pytest.approx(0.6), 2.0, 4.0)]
    (tmp_path / "l.json").write_text(json.dumps({"data/a": ["2024-01-01 00:00:00"], "b": [], "data/b": ["2024-01-01 00:00:00"]}))
    ids = spark.createDataFrame([("a",), ("b",)], "series_id string")
    assert [r.series_id for r in S.labels_for(ids, S.read_labels(spark, str(tmp_path / "l.json"))).collect()] == ["a"]
    for name, text in {"gp/x": '{"event_level": {"f1": 0.5}, "business": {"fp_per_day": 1, "median_latency_minutes": NaN}}', "gp/y": '{"event_level": null}', "lstm/x": '{"best_k": 2}'}.items():
        d = tmp_path / "m" / name
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(text)
    assert [r.Dataset for r in results.first_runs(results.scan_metrics(spark, str(tmp_path / "m"))).orderBy("Model").collect()] == ["x", "x"]
    scores = spark.createDataFrame([("gp", "a/b", 1, 0.5)], "model string, series_id string, idx long, score double")
    results.write_scores(scores, str(tmp_path / "scores"))
    assert [(r.model, r.series_id, r.idx, r.score) for r in results.read_scores(spark, str(tmp_path / "scores")).collect()] == [("gp", "a__b", 1, 0.5)]
    board = results.leaderboard(results.scan_metrics(spark, str(tmp_path / "m"))).collect()
    assert [(r.Model, r.Dataset, r.Event_F1) for r in board] == [("GP", "x", 0.5), ("LSTM", "x", None)]


def test_models():
    t = np.arange(480)
    y = 10 + 0.01 * t + 3 * np.sin(2 * np.pi * t / 48)
    trend, season, rest = stl(y + np.where(t == 200, 20.0, 0.0))
    assert np.allclose(trend + season + rest, y + np.where(t == 200, 20.0, 0.0)) and abs(rest).argmax() == 200
    runs = RunLengths(0.01)
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 100), np.random.default_rng(1).normal(8, 1, 20)])
    assert np.allclose(_log_ratio(3), [lgamma((v + 1) / 2) - lgamma(v / 2) for v in (2, 3, 4)])
    r = [runs.update(v) for v in x]
    assert np.allclose([p[0] for p in r], 0.01) and r[99].argmax() > 90 and r[110].argmax() < 15
    state = RunLengths.restored(runs.state(), hazard=0.01)
    assert np.allclose(state.update(8.0), runs.update(8.0))


def test_lstm_gradients():
    from tidewatch.functions.lstm import Network

    net, rng = Network(3, 2), np.random.default_rng(0)
    x, y = rng.normal(size=(4, 5)), rng.normal(size=4)
    out, memory = net.forward(x)
    grads = net.backward(2 * (out - y[:, None]) / 4, memory)
    loss = lambda: ((net.forward(x)[0][:, 0] - y) ** 2).mean()
    for p, g in zip(net.p, grads, strict=True):
        at = tuple(rng.integers(s) for s in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)
        p[at] += 1e-5


def plain_loess(y, w, q, at):
    """Local line through the q points nearest to a place, point by point."""
    n = len(y)
    lo = max(0, min(n - min(q, n), round(at) - (min(q, n) - 1) // 2))
    x = range(lo, lo + min(q, n))
    h = max(abs(i - at) for i in x) + (max(q - n, 0) // 2)
    k = {i: w[i] * (1.0 if abs(i - at) <= 0.001 * h else (1 - (abs(i - at) / h) ** 3) ** 3 if abs(i - at) <= 0.999 * h else 0.0) for i in x}
    total = sum(k.values())
    if total <= 0:
        return y[max(0, min(n - 1, round(at)))]
    mean = sum(k[i] * i for i in x) / total
    var = sum(k[i] * (i - mean) ** 2 for i in x) / total
    slope = sum(k[i] * (i - mean) * y[i] for i in x) / total / var if var**0.5 > 0.001 * (n - 1) else 0.0
    return sum(k[i] * y[i] for i in x) / total + slope * (at - mean)


def plain_stl(y, period, robust):
    n, trend, w = len(y), [0.0] * len(y), [1.0] * len(y)
    odd = lambda x: -int(-x // 1) + (-int(-x // 1) % 2 == 0)
    mean = lambda v, k: [sum(v[i : i + k]) / k for i in range(len(v) - k + 1)]
    for outer in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = [0.0] * (n + 2 * period)
            for p in range(period):
                part = [y[i] - trend[i] for i in range(p, n, period)]
                for j in range(-1, len(part) + 1):
                    cycle[p + (j + 1) * period] = plain_loess(part, w[p::period], 7, j)
            low = mean(mean(mean(cycle, period), period), 3)
            season = [cycle[period + i] - plain_loess(low, [1.0] * n, odd(period + 1), i) for i in range(n)]
            trend = [plain_loess([y[j] - season[j] for j in range(n)], w, odd(1.5 * period / (1 - 1.5 / 7)), i) for i in range(n)]
        rest = [abs(y[i] - season[i] - trend[i]) for i in range(n)]
        h = 6 * float(np.median(rest))
        if outer < 14:
            w = [1.0 if r <= 0.001 * h else (1 - (r / h) ** 2) ** 2 if r <= 0.999 * h else 0.0 for r in rest]
    return trend, season


@pytest.mark.parametrize("n,robust", [(41, False), (48, True)])
def test_decomposition_equals_plain_loops(n, robust):
    rng = np.random.default_rng(n)
    y = 5 + 0.1 * np.arange(n) + np.tile(rng.normal(size=6), 9)[:n] * 3 + rng.normal(size=n) * 0.3
    y[17] += 15
    trend, season, rest = stl(y, 6, robust=robust)
    want = plain_stl(y.tolist(), 6, robust)
    assert np.allclose(trend, want[0]) and np.allclose(season, want[1]) and np.allclose(trend + season + rest, y)


def test_label_anchors_of_many_labels(spark):
    rng = np.random.default_rng(5)
    at = sorted(rng.integers(0, 300, 60).tolist())
    rows = spark.createDataFrame([("a", i, START + dt.timedelta(minutes=m), 0.0) for i, m in enumerate(at)], "series_id string, idx long, ts timestamp_ntz, value double")
    asked = rng.integers(-20, 330, 40).tolist()
    labels = spark.createDataFrame([(s, START + dt.timedelta(minutes=m)) for m in asked for s in ("a", "none")], "series_id string, label_ts timestamp_ntz")
    got = {r.label_ts: r.anchor for r in E.label_anchors(rows, labels).collect()}
    assert got == {START + dt.timedelta(minutes=m): next((i for i, x in enumerate(at) if x >= m), 60) for m in asked}


def test_one_pass_sweep_equals_joins(spark):
    rng = np.random.default_rng(7)
    rows = [(s, i, float(rng.normal() + 9 * (rng.random() < 0.05)), int(rng.random() < 0.06 and s != "c")) for s in "abc" for i in range(250)]
    scored = R.rolling_sigma(spark.createDataFrame(rows, "series_id string, idx long, value double, is_anomaly int")).cache()
    ks = [0.5, 1.0, 2.0, 6.5]
    for least, gap in ((1, 0), (2, 3)):
        joined = M.sweep(scored, M.flagged_by_k(scored, "value", ks, least), scored.filter("is_anomaly = 1").select("series_id", "idx"), ks, gap)
        one = M.sweep_series(scored, "value", ks, least, gap).select(*joined.columns)
        assert one.count() == 12 and one.exceptAll(joined).count() == joined.exceptAll(one).count() == 0
        assert one.agg(F.sum("tp")).first()[0] > 0


def test_runs_by_threshold_equal_flagged_rows(spark):
    """Whatever the chunks, also where rows are missing between others, and by split."""
    rng = np.random.default_rng(8)
    rows = [(s, "ab"[i > 120], i, float(x)) for s in "pqr" for i, x in enumerate(rng.choice([0, 1, 2, 3, np.nan], 240)) if s != "q" or rng.random() < 0.8]
    rows = spark.createDataFrame(rows, "series_id string, split string, idx long, z double").cache()
    ks, by = [0.5, 1.5, 2.5], ("series_id", "split")
    over = lambda k: F.coalesce(F.col("z") > k, F.lit(False))
    levels = rows.select(*by, "idx", sum((over(k).cast("int") for k in ks), F.lit(0)).alias("level"))
    single = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(over(F.col("k"))).select(*by, "k", "idx")
    for chunk in (1, 2, 7, 1000):
        for least, gap in ((1, 0), (2, 0), (3, 3)):
            want = E.to_events(E.persistent(single, least, (*by, "k")), gap, (*by, "k"))
            got = E.bridged(E.runs_by_k(levels, ks, least, by, chunk), gap, (*by, "k")).select(*want.columns)
            assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(E.rows_of(M.runs_above_by_k(rows, "z", ks, 2).filter("k = 1.5")).collect()) == sorted(M.above_by_k(rows, "z", ks, 2).filter("k = 1.5").select("series_id", "idx").collect())


def test_flags_of_a_sweep_are_not_multiplied_by_thresholds(spark, monkeypatch):
    """Where a forecast is far off, every row is over every threshold: one run for each, not so many rows."""
    n, seen = 3000, []
    rng = np.random.default_rng(9)
    rows = line(spark, 1000 + rng.normal(size=n)).withColumn("is_anomaly", (F.col("idx") % 500 < 3).cast("int")).withColumn("resid", F.col("value"))
    monkeypatch.setattr(pipelines, "once", lambda df: (seen.append(df), df)[1])
    assert pipelines.by_rolling_scale(rows).first().n_true_events == 6
    flagged = [df.count() for df in seen if "k" in df.columns and "series_id" in df.columns]
    assert flagged == [len(M.WIDE_GRID)]


def test_normal_quantiles(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-20, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.7, 0.9251, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", F.expr(D.normal_quantile("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-15)


def test_prediction_rows(spark):
    values = np.concatenate([np.zeros(150), [0, 0, 50, 50, 0, 0], np.zeros(44)]) + np.sin(np.arange(200)) / 10
    rows = line(spark, values).withColumn("is_anomaly", F.lit(0))
    out = pipelines.kalman(rows, rows=True).orderBy("idx").collect()
    assert [r.idx for r in out] == list(range(140, 200)) and [r.idx for r in out if r.detected] == [152, 153]
    left = [r.upper - r.pred_mean for r in out]
    assert min(left) == pytest.approx(max(left)) and left[0] > 0 and all(r.pred_mean - r.lower == pytest.approx(left[0]) for r in out)


def test_stream_equals_batch(spark, tmp_path):
    from tidewatch.streaming import online

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = online.run_available(online.stream_grid(online.events_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"))
    batch = S.grid(events).filter("value != 0").select("series_id", "ts", "value")
    assert got.exceptAll(batch).count() == 0 and got.count() > 0.9 * batch.count()


def test_queries_run_the_detectors_own_defaults(monkeypatch):
    monkeypatch.setattr(plans, "_marked", lambda spark, sf: "rows")
    monkeypatch.setattr(pipelines, "ranked", lambda reports: reports)
    for query, detector in {"hybrid_scores": "hybrid_scores", "pipeline_bsts": "bsts", "pipeline_lstm": "lstm", "pipeline_hybrid": "hybrid", "pipeline_bsts_dummy": "bsts_dummy", "pipeline_bsts_enhanced": "bsts_enhanced", "pipeline_lstm_raw": "lstm_raw", "benchmark_leaderboard": "benchmark"}.items():
        monkeypatch.setattr(pipelines, detector, lambda *args, **more: (args, more))
        assert plans.queries()[query](None, "") == (("rows",), {}), query
    monkeypatch.setattr(models, "structural_forecast", lambda series, train, model, fit_rows=None: model.size)
    assert plans.bsts_forecast(None, "") == 2 + 2 * 10 + 2 * 10
    assert plans.bsts_dummy_forecast(None, "") == 2 + 47
    monkeypatch.setattr(models, "lstm_forecast", lambda *args, **more: more["epochs"])
    assert plans.lstm_forecast(None, "") == 20


def test_fits_take_the_whole_training_part(monkeypatch):
    y, seen = np.sin(np.arange(1440) / 7.0), []
    monkeypatch.setattr(models, "_each", lambda series, columns, work: work(y))
    monkeypatch.setattr(state_space.Structural, "likelihood", lambda self, part, v: seen.append(len(part)) or (0.0, np.zeros(self.kinds)))
    models.local_level_forecast(None)
    models.structural_forecast(None, 0.5, state_space.Structural())
    models.bsts_forecast(None, periods=(48,), harmonics=1)
    assert set(seen) == {int(1440 * 0.7), 720}
    seen.clear()
    monkeypatch.setattr(gaussian_process, "evidence", lambda p, y: seen.append(len(y)) or (0.0, np.zeros(len(p))))
    models.gp_forecast(None)
    assert set(seen) == {720}
