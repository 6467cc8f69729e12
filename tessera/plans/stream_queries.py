"""Queries of event time: windows of a stream over `events`, and edges as of many times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.shared import new_path
from tessera.plans.base import GRAPH, query, relationships, table
from tessera.streaming.windows import window_stream


@query("""WITH mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS passed FROM events WHERE event_id % 97 <> 0)
    SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 2) + 0.0 AS total FROM events, mark
    WHERE event_id % 97 <> 0 OR ts > passed GROUP BY ALL""")
def event_windows_stream(spark, sf):
    """Daily counts of a stream that comes in four deliveries, each read by a new run from the checkpoint: two by time, then every
    97th event late and every 89th again, then a heartbeat that closes all windows. Late events that the watermark has
    passed don't count, repeated ones count once."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    late, again = F.col("event_id") % 97 == 0, F.col("event_id") % 89 == 0
    beat = events.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit("heartbeat").alias("event_type"), F.lit(0.0).alias("value"))
    early = F.dayofmonth("ts") < 15
    place, out, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    for n, some in enumerate((events.where(~late & early), events.where(~late & ~early), events.where(late).unionByName(events.where(again)), beat)):
        some.write.parquet(f"{place}/{n}")
        window_stream(spark, place, events.schema, out, state).awaitTermination()
    return spark.read.parquet(out).select(F.col("window_start").cast("date").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


@query(f"""WITH {GRAPH}, probes AS (SELECT id AS probe_id, subject_id, valid_from + 15 * 86400 AS probed FROM relationships)
    SELECT probe_id, p.subject_id, probed, r.id, predicate, object_id, valid_from FROM probes p JOIN relationships r
    ON r.subject_id = p.subject_id AND valid_from <= probed AND (valid_until IS NULL OR valid_until > probed)""")
def kg_as_of_join(spark, sf):
    """For each edge, those of its subject that hold fifteen days after it began."""
    edges = relationships(spark, sf)
    probes = edges.select(F.col("id").alias("probe_id"), "subject_id", (F.col("valid_from") + 15 * 86400).alias("at"))
    return graph.as_of_join(probes, edges).select("probe_id", "subject_id", F.col("at").alias("probed"), "id", "predicate", "object_id", "valid_from")
