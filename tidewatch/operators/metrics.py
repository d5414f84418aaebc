"""Metrics of flags against labels, by row, by event and by use; sweeps over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import events as E
from tidewatch.operators import rolling as R

EPS = 1e-9


def ratio(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + EPS)


def pointwise(flags: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (flag, is_anomaly) rows."""
    t, p = F.col("is_anomaly") == 1, F.col("flag") == 1
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    m = flags.groupBy(*by).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    m = m.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def event_level(cases: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """For each case (series_id, further keys): tp counts predicted events that meet a true one, fn true events that none
    meets, so the two needn't add up to n_true_events. pred: (*case keys, start_idx, end_idx)."""
    return event_counts(cases, E.matched(pred, true, tuple(cases.columns)), true)


def event_counts(cases: DataFrame, matched: DataFrame, true: DataFrame) -> DataFrame:
    """event_level() from the rows of matched()."""
    keys = cases.columns
    sums = matched.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count("t_start").alias("found"))
    n_true = true.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_true_events"))
    m = cases.join(sums, keys, "left").join(n_true, "series_id", "left").fillna(0, ["tp", "fp", "found", "n_true_events"])
    m = m.withColumn("n_pred_events", F.col("tp") + F.col("fp"))
    m = m.withColumns({"fn": F.col("n_true_events") - F.col("found"), "precision": ratio(F.col("tp"), F.col("n_pred_events")), "recall": ratio(F.col("found"), F.col("n_true_events"))})
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("found")


def business(series: DataFrame, pred: DataFrame, true: DataFrame) -> DataFrame:
    """fp_count, duration_days, fp_per_day, median_latency_minutes (null if no true event is met) of each series."""
    return business_of(series, E.matched(pred, true))


def business_of(series: DataFrame, matched: DataFrame) -> DataFrame:
    """business() from the rows of matched(). Both ends of a latency come from one join with the rows."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(us) - F.min(us)) / 1e6
    span = series.groupBy("series_id").agg(F.when(F.count(F.lit(1)) > 1, seconds / 86400.0).otherwise(F.lit(1.0)).alias("duration_days"))
    fp = matched.groupBy("series_id").agg(F.sum("fp").alias("fp_count"))
    ends = F.explode(F.array(F.struct(F.col("t_start").alias("idx"), F.lit(-1).alias("sign")), F.struct(F.col("p_start").alias("idx"), F.lit(1).alias("sign"))))
    needed = matched.filter("t_start is not null").select("series_id", "t_start", ends.alias("e")).select("series_id", "t_start", "e.*")
    late = needed.join(series.select("series_id", "idx", us.alias("us")), ["series_id", "idx"]).groupBy("series_id", "t_start").agg(F.sum(F.col("us") * F.col("sign")).alias("us"))
    late = late.groupBy("series_id").agg(F.median(F.col("us") / 6e7).alias("median_latency_minutes"))
    per_day = F.when(F.col("duration_days") > 0, F.col("fp_count") / F.col("duration_days")).otherwise(F.lit(0.0))
    return span.join(fp, "series_id", "left").fillna(0, ["fp_count"]).join(late, "series_id", "left").withColumn("fp_per_day", per_day)


def grid_of(first: float, last: float, n: int) -> list[float]:
    return [first + (last - first) * i / (n - 1) for i in range(n)]


K_GRID = grid_of(2.0, 10.0, 17)
WIDE_GRID = grid_of(3.0, 12.0, 10)


def over(col: str, k: Column, plain: Column | None = None) -> Column:
    """R.exceeds(), or where plain holds whether col itself is greater than k."""
    rule = R.exceeds(col, k)
    return rule if plain is None else F.when(plain, F.coalesce(F.col(col) > k, F.lit(False))).otherwise(rule)


def flagged_by_k(scored: DataFrame, col: str, ks: list[float], least: int, by: tuple[str, ...] = ("series_id", "k"), plain: Column | None = None) -> DataFrame:
    """(*by, idx) flagged at each threshold and persistent. Rolling values are computed before the thresholds multiply the
    rows, and only flagged rows go on. plain: rows whose col is itself the score that thresholds are put on."""
    rows = scored.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(over(col, F.col("k"), plain))
    return E.persistent(rows.select(*by, "idx"), least, by)


def above_by_k(scored: DataFrame, col: str, ks: list[float], least: int) -> DataFrame:
    """The same for a plain score and fixed thresholds."""
    rows = scored.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.coalesce(F.col(col) > F.col("k"), F.lit(False)))
    return E.persistent(rows.select("series_id", "k", "idx"), least, ("series_id", "k"))


def _levels(ks: list[float], rule) -> Column:
    return sum((rule(F.lit(k)).cast("int") for k in ks), F.lit(0)).alias("level")


def runs_by_k(scored: DataFrame, col: str, ks: list[float], least: int, by: tuple[str, ...] = ("series_id",), plain: Column | None = None) -> DataFrame:
    """flagged_by_k() as runs (*by, k, start_idx, end_idx), for which rows aren't multiplied by the thresholds."""
    return E.runs_by_k(scored.select(*by, "idx", _levels(ks, lambda k: over(col, k, plain))), ks, least, by)


def runs_above_by_k(scored: DataFrame, col: str, ks: list[float], least: int) -> DataFrame:
    """above_by_k() as runs."""
    return E.runs_by_k(scored.select("series_id", "idx", _levels(ks, lambda k: F.coalesce(F.col(col) > k, F.lit(False)))), ks, least)


def sweep(series: DataFrame, flagged: DataFrame, true_rows: DataFrame, ks: list[float], gap: int = 3) -> DataFrame:
    """Event metrics and anomaly_rate for each (series_id, k), also where nothing is flagged. flagged: rows or runs."""
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    cases = sizes.select("series_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    true = E.to_events(true_rows, gap)
    runs = E.as_runs(flagged, ("series_id", "k"))
    m = event_level(cases, E.bridged(runs, gap, ("series_id", "k")), true)
    rate = runs.groupBy("series_id", "k").agg(F.sum(F.col("end_idx") - F.col("start_idx") + 1).alias("n_flags"))
    m = m.join(rate, ["series_id", "k"], "left").join(sizes, "series_id")
    return m.withColumn("anomaly_rate", F.coalesce("n_flags", F.lit(0)) / F.col("n")).drop("n_flags", "n")


def sweep_series(scored: DataFrame, col: str, ks: list[float], least: int, gap: int = 3, plain: Column | None = None) -> DataFrame:
    """sweep() of flagged_by_k() from the scored rows alone, in one pass: flags, true rows and one mark for each case travel
    together, dealt once by (series_id, k), and events meet by running ends instead of a join. Rows may be a part of their
    series."""
    case = lambda k, kind: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<k:double,kind:int>>")
    flags = F.array_compact(F.array(*[F.when(over(col, F.lit(k), plain), case(k, 1)) for k in ks]))
    true = F.when(F.col("is_anomaly") == 1, F.array(*[case(k, 0) for k in ks])).otherwise(none)
    marks = F.when(F.col("idx") == F.col("first"), F.array(*[case(k, 2) for k in ks])).otherwise(none)
    per = Window.partitionBy("series_id")
    rows = scored.withColumns({"n": F.count(F.lit(1)).over(per), "first": F.min("idx").over(per)}).select("series_id", "idx", "n", F.explode(F.concat(flags, true, marks)).alias("c"))
    rows = rows.select("series_id", "idx", "n", "c.*").repartition("series_id", "k")
    by = ("series_id", "k", "kind")
    order = Window.partitionBy(*by).orderBy("idx")
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(order))
    rows = rows.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*by, "run"))).filter((F.col("kind") != 1) | (F.col("len") >= least))
    starts = F.coalesce((F.col("idx") - F.lag("idx").over(order) > gap + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("new", starts).withColumn("event", F.sum("new").over(order))
    events = rows.groupBy(*by, "event").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("flags"), F.max("n").alias("n"))
    up = Window.partitionBy("series_id", "k").orderBy("first", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("series_id", "k").orderBy(F.desc("first"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    ends = {f"end{kind}": F.max(of(kind, "last")).over(up) for kind in (0, 1)}
    heads = {f"head{kind}": F.min(of(kind, "first")).over(down) for kind in (0, 1)}
    met = lambda kind: F.coalesce(F.col(f"end{kind}") >= F.col("first"), F.lit(False)) | F.coalesce(F.col(f"head{kind}") <= F.col("last"), F.lit(False))
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    pred, true = F.col("kind") == 1, F.col("kind") == 0
    m = events.withColumns(ends).withColumns(heads).groupBy("series_id", "k").agg(
        total(pred & met(0)).alias("tp"),
        total(pred & ~met(0)).alias("fp"),
        total(true & ~met(1)).alias("fn"),
        total(true).alias("n_true_events"),
        total(pred).alias("n_pred_events"),
        (F.sum(F.when(pred, F.col("flags")).otherwise(0)) / F.max("n")).alias("anomaly_rate"),
    )
    m = m.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred_events")), "recall": ratio(F.col("n_true_events") - F.col("fn"), F.col("n_true_events"))})
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best(swept: DataFrame, most: float | None = 0.10, default: float = 3.0) -> DataFrame:
    """(series_id, best_k, best_f1): the largest F1 among thresholds that flag no more than most of the rows, the smallest
    of equals; default and null if there are none."""
    ok = swept if most is None else swept.filter(F.col("anomaly_rate") <= most)
    top = ok.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("f1"), "k"))).filter("r = 1")
    return swept.select("series_id").distinct().join(top, "series_id", "left").select("series_id", F.coalesce("k", F.lit(default)).alias("best_k"), F.col("f1").alias("best_f1"))
