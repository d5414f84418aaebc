"""Flags to events, labels to flags, and how the two overlap.

Flags travel as their flagged rows alone: a run of rows, a merge of runs and an overlap never need the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_anchors(series: DataFrame, labels: DataFrame) -> DataFrame:
    """(series_id, label_ts, anchor, n): the first row at or after each label, n (the length) if there is none.

    Rows and labels go through one window together, latest first, so that the work doesn't depend on how many labels a
    series has. Labels of a series without rows are dropped.
    """
    none = F.lit(None)
    rows = series.select("series_id", F.col("ts").alias("at"), "idx", none.cast("timestamp_ntz").alias("label_ts"))
    both = rows.unionByName(labels.select("series_id", "label_ts").distinct().select("series_id", F.col("label_ts").alias("at"), none.cast("long").alias("idx"), "label_ts"))
    down = Window.partitionBy("series_id").orderBy(F.desc("at"), F.desc_nulls_last("idx")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"next": F.min("idx").over(down), "n": F.count("idx").over(Window.partitionBy("series_id"))})
    return seen.filter(F.col("label_ts").isNotNull() & (F.col("n") > 0)).select("series_id", "label_ts", F.coalesce("next", "n").alias("anchor"), "n")


def label_rows(series: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(series_id, idx) within width rows of an anchor, each once."""
    a = label_anchors(series, labels)
    lo, hi = F.greatest(F.lit(0), F.col("anchor") - width), F.least(F.col("n") - 1, F.col("anchor") + width)
    return a.select("series_id", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi").select("series_id", F.explode(F.sequence("lo", "hi")).alias("idx")).distinct()


def mark(series: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """series with is_anomaly."""
    rows = label_rows(series, labels, width).withColumn("hit", F.lit(1))
    return series.join(rows, ["series_id", "idx"], "left").withColumn("is_anomaly", F.coalesce("hit", F.lit(0))).drop("hit")


def persistent(flagged: DataFrame, least: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The flagged rows (*by, idx) that stand in unbroken runs of at least so many."""
    if least <= 1:
        return flagged
    order = Window.partitionBy(*by).orderBy("idx")
    runs = flagged.withColumn("run", F.col("idx") - F.row_number().over(order))
    return runs.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*by, "run"))).filter(F.col("len") >= least).drop("run", "len")


def to_events(flagged: DataFrame, gap: int = 0, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(*by, start_idx, end_idx) of flagged rows, bridging up to gap rows without a flag."""
    order = Window.partitionBy(*by).orderBy("idx")
    starts = F.coalesce((F.col("idx") - F.lag("idx").over(order) > gap + 1).cast("int"), F.lit(1))
    numbered = flagged.withColumn("new", starts).withColumn("event", F.sum("new").over(order))
    return numbered.groupBy(*by, "event").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx")).drop("event")


#: Rows of a series in one chunk of levels.
CHUNK = 1 << 16


def runs_by_k(levels: DataFrame, ks: list[float], least: int = 1, by: tuple[str, ...] = ("series_id",), chunk: int | None = None) -> DataFrame:
    """(*by, k, start_idx, end_idx): unbroken runs of at least so many rows over each threshold. levels: (*by, idx, level),
    level being how many of ks a row is over: those below it, as thresholds are nested.

    A row is dealt once, by chunks of a series, whatever the number of thresholds; a row of a threshold's own arises only
    where a run over it begins or ends, and those that do both at once go where they are too short. chunk: rows of a series
    that are ordered together, in place of CHUNK."""
    size = chunk or CHUNK
    at, place = F.floor(F.col("idx") / size), F.pmod(F.col("idx"), F.lit(size))
    spot = lambda c, own: F.struct(c.alias("chunk"), F.lit(own).alias("own"))
    spots = F.array(spot(at, True), F.when(place == size - 1, spot(at + 1, False)), F.when(place == 0, spot(at - 1, False)))
    rows = levels.filter("level > 0").select(*by, "idx", "level", F.explode(F.array_compact(spots)).alias("spot")).select(*by, "idx", "level", "spot.*")
    w = Window.partitionBy(*by, "chunk").orderBy("idx")
    beside = lambda f, d: F.when(f("idx").over(w) == F.col("idx") + d, f("level").over(w)).otherwise(0)
    rows = rows.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)}).filter("own")
    low = F.least("before", "after")
    ends = rows.filter(F.col("level") > low).select(*by, "idx", "before", "after", F.explode(F.sequence(low + 1, "level")).alias("nth"))
    ends = ends.select(*by, "idx", "nth", (F.col("nth") > F.col("before")).alias("starts"), (F.col("nth") > F.col("after")).alias("ends"))
    if least > 1:
        ends = ends.filter(~(F.col("starts") & F.col("ends")))
    order = Window.partitionBy(*by, "nth").orderBy("idx")
    runs = ends.withColumn("end_idx", F.when(F.col("ends"), F.col("idx")).otherwise(F.lead("idx").over(order))).filter("starts")
    k = F.element_at(F.array(*[F.lit(float(k)) for k in sorted(ks)]), F.col("nth"))
    return runs.select(*by, k.alias("k"), F.col("idx").alias("start_idx"), "end_idx").filter(F.col("end_idx") - F.col("start_idx") + 1 >= least)


def as_runs(flagged: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(*by, start_idx, end_idx) of flagged rows, or of what is that already."""
    return flagged if "start_idx" in flagged.columns else to_events(flagged, 0, by)


def bridged(runs: DataFrame, gap: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Runs as events: to_events() without their rows."""
    if gap <= 0:
        return runs.select(*by, "start_idx", "end_idx")
    order = Window.partitionBy(*by).orderBy("start_idx")
    starts = F.coalesce((F.col("start_idx") - F.lag("end_idx").over(order) > gap + 1).cast("int"), F.lit(1))
    numbered = runs.withColumn("new", starts).withColumn("event", F.sum("new").over(order))
    return numbered.groupBy(*by, "event").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("event")


def rows_of(runs: DataFrame) -> DataFrame:
    """(series_id, idx) of runs."""
    return runs.select("series_id", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))


def _true(true: DataFrame) -> DataFrame:
    return true.select(F.col("series_id").alias("t_id"), F.col("start_idx").alias("t_start"), F.col("end_idx").alias("t_end"))


def meets(pred: DataFrame, true: DataFrame):
    return (pred.series_id == F.col("t_id")) & (pred.start_idx <= F.col("t_end")) & (pred.end_idx >= F.col("t_start"))


def hits(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Predicted events that meet a true one."""
    t = _true(true)
    return pred.join(t, meets(pred, t), "left_semi")


def meetings(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Each pair of a predicted and a true event that meet: pred's columns, t_start, t_end."""
    t = _true(true)
    return pred.join(t, meets(pred, t)).drop("t_id")


def at_times(series: DataFrame, times: DataFrame) -> DataFrame:
    """The rows of series at one of times (series_id, ts); of several rows at one time, all."""
    return series.join(times.select("series_id", "ts"), ["series_id", "ts"], "left_semi")


def matched(pred: DataFrame, true: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(*by, t_start, tp, fp, p_start) from one overlap join: for each true event that is met, the predicted events of which
    it is the first, and the first one that meets it; with a null t_start, the predicted events that meet none. True events
    of a series don't overlap."""
    before = F.lag("end_idx").over(Window.partitionBy("series_id").orderBy("start_idx"))
    t = true.select(F.col("series_id").alias("t_id"), F.col("start_idx").alias("t_start"), F.col("end_idx").alias("t_end"), F.coalesce(before, F.lit(-1)).alias("t_before"))
    met = pred.join(t, meets(pred, t), "left")
    first = F.coalesce(F.col("t_before") < F.col("start_idx"), F.lit(False))
    alone = F.col("t_start").isNull().cast("long")
    return met.groupBy(*by, "t_start").agg(F.sum(first.cast("long")).alias("tp"), F.sum(alone).alias("fp"), F.min("start_idx").alias("p_start"))


def missed(pred: DataFrame, true: DataFrame) -> DataFrame:
    """True events that no predicted one meets."""
    p = pred.select(F.col("series_id").alias("p_id"), F.col("start_idx").alias("p_start"), F.col("end_idx").alias("p_end"))
    return true.join(p, (true.series_id == F.col("p_id")) & (F.col("p_start") <= true.end_idx) & (F.col("p_end") >= true.start_idx), "left_anti")
