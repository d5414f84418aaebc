"""Charts as SVG text, one for each series, built from rows without a plotting library.

A layer of any number of points is first reduced to what its pixels can show: the lowest and highest point of each column of
pixels, by partial aggregates. Only these meet in a series' row, a few thousand at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, EDGE = 960, 320, 24


def points(rows: DataFrame, layer: str, x: str | Column, y: str | Column) -> DataFrame:
    """(series_id, layer, x, y) of one layer; rows without either are left out."""
    at = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    fine = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return rows.select("series_id", F.lit(layer).alias("layer"), at(x).alias("x"), at(y).alias("y")).filter(fine)


def reduced(layers: DataFrame) -> DataFrame:
    """(series_id, layer, px, x, y, and the series' bounds x0, x1, y0, y1): each column's lowest and highest point."""
    bounds = layers.groupBy("series_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    px = F.when(F.col("x1") > F.col("x0"), F.floor((F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")) * (WIDTH - 1))).otherwise(F.lit(0))
    keys = ["series_id", "layer", "px", "x0", "x1", "y0", "y1"]
    ends = layers.join(bounds, "series_id").withColumn("px", px).groupBy(*keys).agg(F.min(F.struct("y", "x")).alias("low"), F.max(F.struct("y", "x")).alias("high"))
    some = F.array_distinct(F.array("low", "high"))
    return ends.select(*keys, F.explode(some).alias("p")).select(*keys, "p.x", "p.y")


def charts(layers: DataFrame, styles: dict[str, tuple[str, str]], title: str = "") -> DataFrame:
    """(series_id, svg). styles: for each layer, in drawing order, its kind (line, dots or bars) and colour."""
    of = lambda c, lo, hi, size: F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * size).otherwise(F.lit(size / 2))
    placed = reduced(layers).withColumns({"sx": F.round(EDGE + of("x", "x0", "x1", WIDTH), 1), "sy": F.round(EDGE + HEIGHT - of("y", "y0", "y1", HEIGHT), 1)})
    dots = F.array_sort(F.collect_list(F.struct("sx", "sy")))
    kind = F.create_map(*[F.lit(v) for layer, (k, _) in styles.items() for v in (layer, k)])[F.col("layer")]
    colour = F.create_map(*[F.lit(v) for layer, (_, c) in styles.items() for v in (layer, c)])[F.col("layer")]
    order = F.create_map(*[F.lit(v) for i, layer in enumerate(styles) for v in (layer, i)])[F.col("layer")]
    one = placed.groupBy("series_id", "layer").agg(dots.alias("dots"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = text('<polyline fill="none" stroke="', colour, '" points="', F.array_join(F.transform("dots", lambda d: text(d["sx"], ",", d["sy"])), " "), '"/>')
    circles = F.array_join(F.transform("dots", lambda d: text('<circle r="2.5" fill="', colour, '" cx="', d["sx"], '" cy="', d["sy"], '"/>')), "")
    floor = float(EDGE + HEIGHT)
    bars = F.array_join(F.transform("dots", lambda d: text('<line stroke-width="8" stroke="', colour, '" x1="', d["sx"], '" x2="', d["sx"], '" y1="', d["sy"], f'" y2="{floor}"/>')), "")
    drawn = one.select("series_id", order.alias("order"), F.when(kind == "line", line).when(kind == "bars", bars).otherwise(circles).alias("element"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "element"))), lambda e: e["element"]), "")
    name = F.replace(F.replace(F.replace(F.concat(F.lit(f"{title} "), F.col("series_id")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH + 2 * EDGE} {HEIGHT + 2 * EDGE}"><rect width="100%" height="100%" fill="white"/><text x="{EDGE}" y="16">'
    return drawn.groupBy("series_id").agg(body.alias("body")).select("series_id", F.concat(F.lit(head), F.trim(name), F.lit("</text>"), "body", F.lit("</svg>")).alias("svg"))


def forecasts(rows: DataFrame) -> DataFrame:
    """Values, forecast, its band if there is one, and detected rows, over idx."""
    layers = points(rows, "value", "idx", "value").unionByName(points(rows, "forecast", "idx", "pred_mean"))
    for c in ("pred_lower", "pred_upper"):
        if c in rows.columns:
            layers = layers.unionByName(points(rows, c, "idx", c))
    layers = layers.unionByName(points(rows.filter("detected = 1"), "detected", "idx", "value"))
    return charts(layers, {"pred_lower": ("line", "#bbbbbb"), "pred_upper": ("line", "#bbbbbb"), "value": ("line", "#1f77b4"), "forecast": ("line", "#ff7f0e"), "detected": ("dots", "#d62728")}, "Forecast")


def quantiles(qq: DataFrame) -> DataFrame:
    """Rows of diagnostics.qq()."""
    return charts(points(qq, "qq", "theoretical", "ordered"), {"qq": ("dots", "#1f77b4")}, "Residual quantiles")


def densities(histogram: DataFrame) -> DataFrame:
    """Rows of diagnostics.histogram(), as bars that stand on 0."""
    bars = points(histogram, "density", "bin", "density").unionByName(points(histogram, "floor", "bin", F.lit(0.0)))
    return charts(bars, {"density": ("bars", "#1f77b4"), "floor": ("line", "#000000")}, "Residual density")


def volatility(rows: DataFrame) -> DataFrame:
    """Rows of rolling.volatility()."""
    return charts(points(rows, "volatility", "idx", "volatility"), {"volatility": ("line", "#ff7f0e")}, "Rolling deviation")


def precision_recall(curve: DataFrame) -> DataFrame:
    """Rows of diagnostics.pr_curve()."""
    return charts(points(curve, "curve", "recall", "precision"), {"curve": ("line", "#ff7f0e")}, "Precision and recall")
