"""Series from a stream: regular grids with watermarks, and online changepoints with state for each series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.changepoints import RunLengths
from tidewatch.session import ship


def events_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, from a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_grid(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, value): sums by tumbling windows, given out when the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = timed.groupBy(F.col("event_type").alias("series_id"), F.window("at", f"{minutes} minutes")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return sums.select("series_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "value")


def online_changepoints(rows: DataFrame, hazard: float = 0.01, tail: float = 1e-12, idle: str | None = None) -> DataFrame:
    """(series_id, ts, value, cp_prob, map_run_length) for streamed (series_id, ts, value); the posterior is the state.

    All rows of a series in one trigger are scored in the order of their times, however many batches they come in. A row no
    later than one already scored in an earlier trigger can't be put in its place any more: it comes out with null scores and
    leaves the state as it is. idle: forget a series that has had no row for so long (as '1 day', by the clock); its next row
    begins anew."""
    ship(rows.sparkSession)
    milliseconds = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values("ts", kind="stable")
        runs, last = RunLengths(hazard, tail=tail), None
        if state.exists:
            runs, last = RunLengths.restored(bytes(state.get[0]), hazard=hazard, tail=tail), pd.Timestamp(state.get[1], unit="us")
        late = f["ts"].to_numpy() <= np.datetime64(last) if last is not None else np.zeros(len(f), bool)
        out = [(np.nan, pd.NA) if behind else (float(r[0]), int(r.argmax())) for behind, r in ((b, None if b else runs.update(v)) for b, v in zip(late, f["value"], strict=True))]
        if not late.all():
            last = f["ts"].to_numpy()[~late].max()
            state.update((runs.state(), int(pd.Timestamp(last).value // 1000)))
        if milliseconds is not None:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({"series_id": f["series_id"], "ts": f["ts"], "value": f["value"], "cp_prob": pd.array([None if np.isnan(a) else a for a, _ in out], "Float64"), "map_run_length": pd.array([b for _, b in out], "Int64")})

    columns = "series_id string, ts timestamp_ntz, value double, cp_prob double, map_run_length long"
    return rows.groupBy("series_id").applyInPandasWithState(update, columns, "posterior binary, last long", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write everything that is there now as Parquet, exactly once, and read it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
