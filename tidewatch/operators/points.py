"""Row-wise work on series: splits, scaling, bands, predicates; and scales over a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def by_series():
    return Window.partitionBy("series_id")


def with_length(series: DataFrame) -> DataFrame:
    return series.withColumn("n", F.count(F.lit(1)).over(by_series()))


def split(series: DataFrame, train: float = 0.5, validation: float = 0.25) -> DataFrame:
    """A split column: Train, Validation, Test; bounds are whole numbers rounded down."""
    s = with_length(series)
    first, second = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    return s.withColumn("split", F.when(F.col("idx") < first, "Train").when(F.col("idx") < second, "Validation").otherwise("Test")).drop("n")


def tail(series: DataFrame, train: float, rows: int) -> DataFrame:
    """The last rows of the training part."""
    end = F.floor(F.col("n") * train)
    return with_length(series).filter((F.col("idx") < end) & (F.col("idx") >= F.greatest(F.lit(0), end - rows))).drop("n")


def zscore(series: DataFrame, col: str = "value", scope: Column | None = None, eps: float = 0.0) -> DataFrame:
    """mu, sigma (population) and z over the rows in scope, by default all."""
    x = F.col(col) if scope is None else F.when(scope, F.col(col))
    s = series.withColumns({"mu": F.avg(x).over(by_series()), "sigma": F.stddev_pop(x).over(by_series())})
    return s.withColumn("z", (F.col(col) - F.col("mu")) / (F.col("sigma") + F.lit(eps)))


def unscaled(z: Column) -> Column:
    return z * F.col("sigma") + F.col("mu")


def centred(series: DataFrame, col: str) -> DataFrame:
    """col less its median over the series."""
    return series.withColumn("centred", F.col(col) - F.median(col).over(by_series()))


def mad_scale(series: DataFrame, col: str = "value") -> DataFrame:
    """(series_id, mad_sigma): 1.4826 times the median distance from the median, both exact."""
    middle = series.groupBy("series_id").agg(F.median(col).alias("m"))
    return series.join(middle, "series_id").groupBy("series_id").agg((F.median(F.abs(F.col(col) - F.col("m"))) * 1.4826).alias("mad_sigma"))


def band(mean: Column, sigma: Column, width: float) -> dict[str, Column]:
    return {"lower": mean - width * sigma, "upper": mean + width * sigma}


def outside(x: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce((x < lower) | (x > upper), F.lit(False)).cast("int")


def beyond(x: Column, mean: Column, sigma: Column, k: float) -> Column:
    return F.coalesce(F.abs(x - mean) > k * sigma, F.lit(False)).cast("int")


def finite(x: Column) -> Column:
    """Missing as 0, infinities as the largest double."""
    x = F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))
    return F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))


def ensemble(scores: dict[str, float]) -> Column:
    """Weighted mean of score columns, missing ones as 0."""
    total = sum(scores.values())
    out = F.lit(0.0)
    for name, w in scores.items():
        out = out + finite(F.col(name)) * w
    return out / total
