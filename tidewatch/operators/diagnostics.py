"""Shapes of residuals and scores: moments, histograms, curves, autocorrelations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_series():
    return Window.partitionBy("series_id")


def moments(series: DataFrame, col: str = "value") -> DataFrame:
    """Excess kurtosis (biased) and the normal fit (mean and population deviation)."""
    return series.groupBy("series_id").agg(F.kurtosis(col).alias("kurtosis"), F.avg(col).alias("mu"), F.stddev_pop(col).alias("sigma"))


def histogram(series: DataFrame, col: str = "value", bins: int = 50) -> DataFrame:
    """(series_id, bin, n, density) of equal bins from the least to the largest value, which is in the last."""
    s = series.withColumns({"lo": F.min(col).over(by_series()), "hi": F.max(col).over(by_series()), "total": F.count(col).over(by_series())}).filter(F.col(col).isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("lo")) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    counts = s.withColumns({"bin": b.cast("int"), "width": width}).groupBy("series_id", "bin", "width", "total").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("series_id", "bin", "n", F.when(F.col("width") > 0, F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def pr_curve(scored: DataFrame, score: str = "score") -> DataFrame:
    """(series_id, threshold, precision, recall) at each distinct score."""
    at = scored.filter(F.col(score).isNotNull()).groupBy("series_id", F.col(score).alias("threshold")).agg(F.sum("is_anomaly").alias("pos"), F.count(F.lit(1)).alias("cnt"))
    down = Window.partitionBy("series_id").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    s = at.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("cnt").over(down), "all": F.sum("pos").over(by_series())})
    recall = F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(F.lit(1.0))
    return s.select("series_id", "threshold", (F.col("tp") / F.col("seen")).alias("precision"), recall.alias("recall"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """Trapezoids under the curve from its anchor at recall 0 and precision 1."""
    w = Window.partitionBy("series_id").orderBy(F.desc("threshold"))
    s = curve.withColumns({"r0": F.lag("recall", 1, 0.0).over(w), "p0": F.lag("precision", 1, 1.0).over(w)})
    return s.groupBy("series_id").agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("auc"))


#: Rows of a series that one task multiplies at once.
CHUNK = 1 << 17


def acf(series: DataFrame, lags: int = 50, col: str = "value", chunk: int | None = None) -> DataFrame:
    """(series_id, lag, acf) for lags from 0, with the biased denominator; missing values count as the mean.

    A series of any length is cut into chunks of rows, each with the first lags rows of the next; sums of products by lag
    come from the chunks and are added up."""
    size = max(chunk or CHUNK, lags)
    mean = series.groupBy("series_id").agg(F.avg(col).alias("m"))
    d = series.join(mean, "series_id").select("series_id", "idx", F.coalesce(F.col(col) - F.col("m"), F.lit(0.0)).alias("d"))
    own = F.floor(F.col("idx") / size)
    places = F.when((F.col("idx") % size < lags) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = d.select("series_id", "idx", "d", F.explode(places).alias("chunk"))

    def products(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        d, n = f["d"].to_numpy(), int((f["idx"] // size == key[1]).sum())
        p = [float(d[: min(n, len(d) - h)] @ d[h : h + n]) if h < len(d) else 0.0 for h in range(lags + 1)]
        return pd.DataFrame({"series_id": key[0], "lag": np.arange(lags + 1, dtype=np.int32), "p": p})

    sums = dealt.groupBy("series_id", "chunk").applyInPandas(products, "series_id string, lag int, p double").groupBy("series_id", "lag").agg(F.sum("p").alias("p"))
    none = F.max(F.when(F.col("lag") == 0, F.col("p"))).over(by_series())
    return sums.select("series_id", "lag", (F.col("p") / none).alias("acf"))


def pacf(correlations: DataFrame) -> DataFrame:
    """(series_id, lag, pacf) from acf rows, by the Levinson-Durbin recursion."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r = f.sort_values("lag")["acf"].to_numpy()
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[1:k][::-1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - a * phi[::-1], a)
            out.append(a)
        return pd.DataFrame({"series_id": f["series_id"].iloc[0], "lag": range(len(r)), "pacf": out})

    return correlations.groupBy("series_id").applyInPandas(run, "series_id string, lag int, pacf double")


#: Wichura's rational approximations of the normal quantile (algorithm AS 241, PPND16), numerators and
#: denominators for the middle, the near tail and the far tail, constant terms first.
QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_quantile(p: str) -> str:
    """SQL (Spark's and others') of the standard normal quantile of an expression between 0 and 1."""

    def over(x: str, which: int) -> str:
        poly = [reduce(lambda acc, c: f"({acc}) * ({x}) + {c:.20e}", reversed(cs[:-1]), f"{cs[-1]:.20e}") for cs in QUANTILE[which]]
        return f"(({poly[0]}) / ({poly[1]}))"

    q = f"(({p}) - CAST(0.5 AS DOUBLE))"
    r = f"sqrt(-ln(least({p}, CAST(1 AS DOUBLE) - ({p}))))"
    tail = f"CASE WHEN {r} <= 5 THEN {over(f'{r} - 1.6e0', 1)} ELSE {over(f'{r} - 5e0', 2)} END"
    return f"CASE WHEN abs{q} <= 0.425e0 THEN {q} * {over(f'0.180625e0 - {q} * {q}', 0)} ELSE sign{q} * ({tail}) END"


def qq(series: DataFrame, col: str = "value") -> DataFrame:
    """(series_id, nth, theoretical, ordered): values in order against normal quantiles at Filliben's positions."""
    order = Window.partitionBy("series_id").orderBy(col, "idx")
    s = series.withColumns({"nth": F.row_number().over(order), "n": F.count(F.lit(1)).over(by_series())})
    end = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("nth") == F.col("n"), end).when(F.col("nth") == 1, 1 - end).otherwise((F.col("nth") - 0.3175) / (F.col("n") + 0.365))
    return s.withColumn("p", p).select("series_id", "nth", F.expr(normal_quantile("p")).alias("theoretical"), F.col(col).alias("ordered"))
