"""Trailing windows over a series, and the detectors that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def trailing(window: int, by: tuple[str, ...] = ("series_id",)):
    return Window.partitionBy(*by).orderBy("idx").rowsBetween(-(window - 1), 0)


#: Rows of a series in one chunk of a long window.
CHUNK = 1 << 20


def chunked(series: DataFrame, before: int, chunk: int) -> DataFrame:
    """series with chunk, and own: rows of each chunk of idx, and the rows just before it, which aren't its own. Trailing
    windows by chunk then see what they would see by series, and one long series is the work of many tasks."""
    at = F.floor(F.col("idx") / chunk)
    late = F.col("idx") % chunk >= chunk - before
    places = F.when(late, F.array(F.struct(at.alias("chunk"), F.lit(True).alias("own")), F.struct((at + 1).alias("chunk"), F.lit(False).alias("own"))))
    places = places.otherwise(F.array(F.struct(at.alias("chunk"), F.lit(True).alias("own"))))
    return series.withColumn("place", F.explode(places)).select(*[F.col(f"`{c}`") for c in series.columns], "place.chunk", "place.own")


def rolling_stats(series: DataFrame, col: str = "value", window: int = 48, least: int = 5, by: tuple[str, ...] = ("series_id",), chunk: int | None = None) -> DataFrame:
    """mean_roll and std_roll (sample) over the last window rows; null before least values are there. Rows of a series (by)
    are those of consecutive idx. chunk: rows of a series that one task may hold, in place of CHUNK; a window at least."""
    size = max(chunk or CHUNK, window)
    w = trailing(window, (*by, "chunk"))
    enough = F.count(col).over(w) >= least
    s = chunked(series, window - 1, size).withColumns({"mean_roll": F.when(enough, F.avg(col).over(w)), "std_roll": F.when(enough, F.stddev_samp(col).over(w))})
    return s.filter("own").drop("chunk", "own")


def backfilled(series: DataFrame, *cols: str, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Nulls as the next value in time. The frame runs backwards, which is linear; a forward one to the end isn't."""
    w = Window.partitionBy(*by).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def rolling_sigma(series: DataFrame, col: str = "value", window: int = 48, least: int = 5, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds mean_roll and std_roll, filled backwards: all that exceeds() needs, once for any number of thresholds."""
    return backfilled(rolling_stats(series, col, window, least, by), "mean_roll", "std_roll", by=by)


def exceeds(col: str, k: Column) -> Column:
    """Whether a row departs from its rolling mean by more than k rolling deviations. The window holds the row itself, so
    no row ever exceeds (n - 1) / sqrt(n) for a window of n."""
    return F.coalesce(F.abs(F.col(col) - F.col("mean_roll")) > k * (F.col("std_roll") + EPS), F.lit(False))


def residual_z(series: DataFrame, col: str, mode: str, k: float = 3.0, window: int = 50, train: Column | None = None) -> DataFrame:
    """flag by |residual| over a scale: 'std' (sample), 'mad', or 'rolling' (not centred; a zero deviation counts as the
    training residuals' population deviation, 1 if there are none). A scale of 0 flags nothing."""
    per = Window.partitionBy("series_id")
    if mode == "rolling":
        s = backfilled(rolling_stats(series, col, window, 5), "std_roll")
        spare = F.lit(1.0) if train is None else F.coalesce(F.stddev_pop(F.when(train, F.col(col))).over(per), F.lit(1.0))
        s = s.withColumn("scale", F.when(F.col("std_roll") == 0, spare).otherwise(F.col("std_roll")))
    elif mode == "mad":
        s = series.withColumn("m", F.median(col).over(per))
        s = s.withColumn("scale", F.median(F.abs(F.col(col) - F.col("m"))).over(per) * 1.4826).drop("m")
    else:
        s = series.withColumn("scale", F.stddev_samp(col).over(per))
    return s.withColumn("flag", F.coalesce((F.col("scale") > 0) & (F.abs(F.col(col)) / F.col("scale") > k), F.lit(False)).cast("int"))


def rolling_score(series: DataFrame, col: str, window: int = 48, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """score: |residual| over its rolling deviation; rows without either are 0."""
    s = backfilled(rolling_stats(series, col, window, 1, by), "std_roll", by=by)
    return s.withColumn("score", F.coalesce(F.abs(F.col(col)) / (F.col("std_roll") + 1e-9), F.lit(0.0)))


def volatility(series: DataFrame, col: str = "value", window: int = 48) -> DataFrame:
    return rolling_stats(series, col, window, window).withColumnRenamed("std_roll", "volatility").drop("mean_roll")


def sequences(series: DataFrame, length: int = 48, col: str = "value") -> DataFrame:
    """(series_id, idx, window, target): the length values before each row that has as many."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-length, -1)
    s = series.withColumn("window", F.collect_list(F.col(col).cast("float")).over(w))
    return s.filter(F.size("window") == length).select("series_id", "idx", "window", F.col(col).cast("float").alias("target"))
