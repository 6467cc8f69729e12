"""Counts and sums of events by window of event time, as a stream with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def event_windows(events: DataFrame, *, length: str = "1 day", delay: str = "2 days", id: str = "event_id", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:  # noqa: A002
    """(window_start, key, events, total) of events, streamed or not.

    An event that comes again counts once. Events that come when the watermark, the latest time seen less `delay`, has passed
    them don't count. A window is given when the watermark passes its end, and both the events known for repeats and
    the open windows are dropped from the state by then, so that it holds about `delay` and a window of events."""
    seen = events.withWatermark(time, delay).dropDuplicatesWithinWatermark([id]) if events.isStreaming else events.dropDuplicates([id])
    out = seen.groupBy(F.window(time, length).alias("_window"), key).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("_window.start").alias("window_start"), key, "events", "total")


def window_stream(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, *, trigger: dict | None = None, max_files: int = 1000, **kw) -> StreamingQuery:
    """Windows of the Parquet files that come into path, appended to out as Parquet, each once: the sink's log and the
    checkpoint (both in shared folders) let a new run go on where one ended or broke. trigger: by default all that is there."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(path)
    return event_windows(events, **kw).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(out)
