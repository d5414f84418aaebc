"""Files with names of their own, series files with many kinds of header, charts, and order in streams."""

import datetime as dt
import json
import os
import time
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import START, line
from tidewatch.functions.changepoints import RunLengths
from tidewatch.operators import diagnostics as D
from tidewatch.operators import plots
from tidewatch.operators import rolling as R
from tidewatch.sources import files, results
from tidewatch.sources import series as S
from tidewatch.streaming import online


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


RUNS = """model string, series_id string, pointwise struct<precision:double, recall:double, f1:double, tp:double, fp:double, fn:double>,
event_level struct<precision:double, recall:double, f1:double, tp:long, fp:long, fn:long, n_true_events:long, n_pred_events:long>,
business struct<fp_per_day:double, median_latency_minutes:double, fp_count:long, duration_days:double>, best_k double"""


def test_metrics_round_trip(spark, tmp_path):
    level = (0.5, 0.25, 1 / 3, 1, 2, 3, 4, 5)
    rows = [("gp", "real/a.csv", None, level, (1.5, float("nan"), 3, 2.0), 2.5), ("gp", "b", (1.0, 0.0, 0.5, 1.0, 2.0, 3.0), None, None, None), ("lstm", "real/a.csv", None, level, None, 3.0)]
    runs = spark.createDataFrame(rows, RUNS).repartition(3)
    results.write_metrics(runs, str(tmp_path / "m"))
    assert tree(tmp_path / "m") == ["gp/b/metrics.json", "gp/real__a.csv/metrics.json", "lstm/real__a.csv/metrics.json"]
    text = (tmp_path / "m/gp/real__a.csv/metrics.json").read_text()
    assert json.loads(text)["event_level"]["n_true_events"] == 4 and "NaN" in text and '"NaN"' not in text
    got = {(r.Model, r.Dataset): r for r in results.scan_metrics(spark, str(tmp_path / "m")).collect()}
    for model, name, *parts in rows:
        r = got[model.upper(), name.replace("/", "__")]
        for part, c in zip(parts, ("pointwise", "event_level", "business", "best_k"), strict=True):
            assert str(r[c] if not isinstance(r[c], tuple) else tuple(r[c])) == str(part), (model, name, c)
    # another run replaces its own file and leaves the others; the leaderboard stands beside them
    results.write_metrics(runs.filter("model = 'lstm'").withColumn("best_k", F.lit(9.0)), str(tmp_path / "m"))
    board = results.leaderboard(results.scan_metrics(spark, str(tmp_path / "m")))
    results.write_leaderboard(board, str(tmp_path / "m"))
    assert len(tree(tmp_path / "m")) == 4
    lines = (tmp_path / "m/metrics_summary.csv").read_text().splitlines()
    assert lines[0] == "Model,Dataset,Event_F1,Precision,Recall,FP_per_Day,Latency_Min" and len(lines) == 4
    assert [tuple(r)[:3] for r in results.read_leaderboard(spark, str(tmp_path / "m")).collect()] == [tuple(r)[:3] for r in board.collect()]


def test_predictions_file(spark, tmp_path):
    rows = line(spark, [3, 1, 2], "a/b").withColumns({"model": F.lit("gp"), "detected": F.lit(None).cast("int")}).repartition(3)
    results.write_predictions(rows.select("model", "series_id", "idx", F.col("ts").alias("timestamp"), "value", "detected"), str(tmp_path / "p"))
    assert (tmp_path / "p/gp/a__b/predictions.csv").read_text().splitlines() == ["timestamp,value,detected", "2024-01-01 00:00:00,3.0,", "2024-01-01 00:30:00,1.0,", "2024-01-01 01:00:00,2.0,"]


def test_failed_tasks_leave_no_file(spark, tmp_path):
    rows = spark.range(0, 8, 1, 4).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("content"))
    (tmp_path / "w").mkdir()
    (tmp_path / "w/kept").write_text("k")
    with pytest.raises(Exception, match="lost"):
        files.write_files(rows, str(tmp_path / "w"))
    assert tree(tmp_path / "w") == ["kept"] and os.listdir(tmp_path / "w") == ["kept"]
    for bad in ("../up", "a//b", "/a", "a/."):
        with pytest.raises(Exception, match="lead down"):
            files.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), str(tmp_path / "w"))
    with pytest.raises(Exception, match="come together"):
        files.write_files(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "path string, content string").coalesce(1), str(tmp_path / "w"))
    with pytest.raises(Exception, match="two tasks"):
        files.write_files(spark.range(0, 2, 1, 2).select(F.lit("a").alias("path"), F.lit("x").alias("content")), str(tmp_path / "w"))
    assert os.listdir(tmp_path / "w") == ["kept"]
    files.write_files(spark.createDataFrame([("a/é", None), ("a/é", "2")], "path string, content string").coalesce(1), f"file://{tmp_path}/w", header="h", overwrite=True)
    assert tree(tmp_path / "w") == ["a/é"] and (tmp_path / "w/a/é").read_text() == "h\n\n2\n"


def test_many_kinds_of_header(spark, tmp_path, monkeypatch):
    """One scan, whatever the number of kinds; nothing is collected to plan it."""
    for i in range(60):
        names = [f"note{i}", "value", "timestamp"] if i % 3 == 0 else ["time", f"count{i}"] if i % 3 == 1 else ["timestamp", f"c{i}", "value"]
        cell = {"value": str(i), "timestamp": "2024-01-01 00:00:00", "time": "2024-01-01 00:00:00", f"count{i}": str(i), f"note{i}": '"x, ""y"""', f"c{i}": ""}
        (tmp_path / f"f{i:02d}.csv").write_text(("﻿" if i == 7 else "") + ",".join(f" {n}" for n in names) + "\r\n" + ",".join(cell[n] for n in names) + "\n\n" + ",".join(cell[n].replace("00:00:00", "00:30:00") for n in names) + "\n")
    jobs = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", lambda self: jobs.append(1))
    df = S.read_csv(spark, f"{tmp_path}/*.csv")
    monkeypatch.undo()
    assert not jobs
    got = sorted(map(tuple, df.collect()))
    assert got == [(f"f{i:02d}.csv", k, START + dt.timedelta(minutes=30 * k), float(i)) for i in range(60) for k in range(2)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    (tmp_path / "bad.csv").write_text("x\n1\n")
    with pytest.raises(Exception, match="bad.csv: a series needs"):
        S.read_csv(spark, f"{tmp_path}/*.csv").collect()


def test_charts(spark):
    rows = line(spark, np.sin(np.arange(5000) / 100), "a<&b").unionByName(line(spark, [1.0], "one"))
    rows = rows.withColumns({"pred_mean": F.when(F.col("idx") > 10, F.col("value") + 0.1), "pred_lower": F.col("value") - 1, "pred_upper": F.col("value") + 1, "detected": (F.col("idx") % 1000 == 500).cast("int")})
    got = {r.series_id: r.svg for r in plots.forecasts(rows).collect()}
    assert set(got) == {"a<&b", "one"}
    ns = "{http://www.w3.org/2000/svg}"
    root = ET.fromstring(got["a<&b"])
    assert root.find(f"{ns}text").text == "Forecast a<&b" and len(root.findall(f"{ns}circle")) == 5 and len(root.findall(f"{ns}polyline")) == 4
    for p in root.findall(f"{ns}polyline"):
        at = np.array([[float(v) for v in x.split(",")] for x in p.get("points").split()])
        assert len(at) <= 2 * plots.WIDTH and (np.diff(at[:, 0]) >= 0).all()
        assert at.min() >= 0 and at[:, 0].max() <= plots.WIDTH + 2 * plots.EDGE and at[:, 1].max() <= plots.HEIGHT + 2 * plots.EDGE
    reduced = plots.reduced(plots.points(rows, "v", "idx", "value")).filter("series_id != 'one'").toPandas()
    assert reduced.y.max() == pytest.approx(rows.agg(F.max(F.when(F.col("series_id") != "one", F.col("value")))).first()[0]) and reduced.groupby("px").size().max() <= 2
    scored = rows.withColumns({"score": F.abs("value"), "is_anomaly": F.col("detected")})
    for chart in (plots.quantiles(D.qq(rows)), plots.densities(D.histogram(rows)), plots.volatility(R.volatility(rows)), plots.precision_recall(D.pr_curve(scored))):
        for r in chart.collect():
            ET.fromstring(r.svg)
    assert plots.forecasts(rows.limit(0)).count() == 0


def test_stream_orders_a_trigger_and_marks_late_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 1, 40), rng.normal(6, 1, 40)])
    rows = line(spark, values).select("series_id", "ts", "value")
    schema = "series_id string, ts timestamp_ntz, value double"
    src = str(tmp_path / "in")
    # one trigger of many files in no order
    rows.filter(F.col("ts") < F.lit(START + dt.timedelta(minutes=30 * 60))).repartition(7).write.parquet(src)
    stream = lambda: online.online_changepoints(spark.readStream.schema(schema).parquet(src))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    first = online.run_available(stream(), out, state).orderBy("ts").collect()
    runs = RunLengths(0.01, tail=1e-12)
    want = [runs.update(v) for v in values]
    assert [r.map_run_length for r in first] == [int(p.argmax()) for p in want[:60]]
    # the rest, and a row that comes too late
    rows.filter(F.col("ts") >= F.lit(START + dt.timedelta(minutes=30 * 60))).unionByName(rows.filter(F.col("ts") == F.lit(START))).repartition(3).write.mode("append").parquet(src)
    both = online.run_available(stream(), out, state).orderBy("ts").collect()
    late = [r for r in both if r.map_run_length is None]
    assert len(both) == 81 and [(r.ts, r.cp_prob) for r in late] == [(START, None)]
    assert [r.map_run_length for r in both if r.map_run_length is not None] == [int(p.argmax()) for p in want]


def test_stream_with_idle_time(spark, tmp_path):
    """State that may expire is looked at by the clock: the query runs on until it is stopped."""
    rows = line(spark, np.arange(5.0)).select("series_id", "ts", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = online.online_changepoints(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), idle="1 hour")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while not any(p["numInputRows"] for p in query.recentProgress) and query.isActive and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 5
