"""Series and labels from files and raw events: (series_id, idx, ts, value), idx counting from 0 in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def indexed(rows: DataFrame) -> DataFrame:
    """Number (series_id, ts, value) in time order; equal times in the order of their values."""
    order = Window.partitionBy("series_id").orderBy("ts", "value")
    return rows.select("series_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "ts", "value")


def _fields(line: Column) -> Column:
    """The fields of a CSV line, quotes taken off."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))


def read_csv(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Series files, one series each, named by their path below root (or by file name).

    Each file's own header counts: files whose header lacks 'timestamp' or 'value' have their first two columns taken for
    them; fewer than two columns are an error, as are times that don't parse. Any number of files with any number of kinds
    of header is one scan: a file's header, its first line, is a row of its own that meets the lines in a join by file, on
    the same exchange that numbers each series' rows. Empty lines and further lines like the header are left out.
    """
    file = F.col("_metadata.file_path")
    name = F.substring_index(file, root.rstrip("/") + "/", -1) if root else F.element_at(F.split(file, "/"), -1)
    text = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), name.alias("series_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # a file's first block is read by one task, in order
    heads = text.filter("block = 0").groupBy("series_id").agg(F.min_by("line", "at").alias("head"))
    names = F.transform(_fields(F.col("head")), F.trim)
    enough = F.when(F.size(names) < 2, F.raise_error(F.concat("series_id", F.lit(": a series needs a time and a value column")))).otherwise(names)
    heads = heads.withColumn("names", enough)
    own = F.array_contains("names", "timestamp") & F.array_contains("names", "value")
    place = lambda column, other: F.when(own, F.array_position("names", column)).otherwise(F.lit(other))
    heads = heads.select("series_id", "head", place("timestamp", 1).cast("int").alias("time"), place("value", 2).cast("int").alias("number"))
    rows = text.join(heads, "series_id").filter((F.col("line") != F.col("head")) & (F.trim("line") != "")).withColumn("x", _fields(F.col("line")))
    return indexed(rows.select("series_id", F.to_timestamp_ntz(F.get("x", F.col("time") - 1)).alias("ts"), F.get("x", F.col("number") - 1).cast("double").alias("value")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, label_ts) of a JSON object of arrays of times, and a row with a null time for each key without any."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "times"))
    return pairs.select("key", F.explode_outer("times").alias("t")).select("key", F.to_timestamp_ntz("t").alias("label_ts"))


def labels_for(series_ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(series_id, label_ts): a series' labels stand under its own name or, only if that isn't there at all, under
    data/ and the name. Keys with an empty list count as there."""
    own = labels.select(F.col("key").alias("series_id"), "label_ts").withColumn("rank", F.lit(0))
    other = labels.filter(F.col("key").startswith("data/")).select(F.regexp_replace("key", "^data/", "").alias("series_id"), "label_ts").withColumn("rank", F.lit(1))
    found = series_ids.select("series_id").distinct().join(own.unionByName(other), "series_id")
    best = F.min("rank").over(Window.partitionBy("series_id"))
    return found.withColumn("best", best).filter((F.col("rank") == F.col("best")) & F.col("label_ts").isNotNull()).select("series_id", "label_ts")


def grid(events: DataFrame, minutes: int = 30, key: str = "event_type") -> DataFrame:
    """Sums of value on a regular grid for each key; cells without events are 0. Sums are exact to 2 decimals."""
    step = f"{minutes} minutes"
    cells = events.groupBy(F.col(key).alias("series_id"), F.window("ts", step)["start"].alias("ts")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    ends = cells.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ids = cells.select("series_id").distinct().join(F.broadcast(ends))  # ends is one row
    every = ids.select("series_id", F.posexplode(F.expr(f"sequence(lo, hi, interval {step})")).alias("idx", "ts"))
    return every.join(cells, ["series_id", "ts"], "left").select("series_id", F.col("idx").cast("long").alias("idx"), "ts", F.coalesce("v", F.lit(0.0)).alias("value"))


def top_event_times(events: DataFrame, n: int = 5) -> DataFrame:
    """(series_id, label_ts) of each type's n largest events: stand-ins where no incident times are recorded."""
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return events.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select(F.col("event_type").alias("series_id"), F.col("ts").alias("label_ts"))


def daily_orders(orders: DataFrame) -> DataFrame:
    """Daily order totals by status, on the days that have any."""
    rows = orders.groupBy(F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return indexed(rows)
