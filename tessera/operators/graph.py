"""The temporal knowledge graph: entities and relationships as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import new_rows

QUERY_ROWS = 100
#: Buckets of time that an interval is copied into at most.
LONG = 32


def upsert_entities(entities: DataFrame, seen: DataFrame, now: int, first: int | None = None) -> DataFrame:
    """entities after seeing (name, entity_type): new names are added, known ones get last_seen = now."""
    names = seen.groupBy("name").agg(F.min("entity_type").alias("entity_type"))
    old = entities.join(names.select("name", F.lit(True).alias("_hit")), "name", "left").select(
        "id", "name", "entity_type", "first_seen", F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("last_seen")).alias("last_seen"))
    fresh = new_rows(entities, names, ["name"], first=first).select(
        "id", "name", "entity_type", F.lit(now).cast("long").alias("first_seen"), F.lit(now).cast("long").alias("last_seen"))
    return old.unionByName(fresh)


def active_edges(relationships: DataFrame) -> DataFrame:
    return relationships.where(F.col("valid_until").isNull())


def fresh_edges(relationships: DataFrame, edges: DataFrame, now: int, first: int | None = None) -> DataFrame:
    """The edges (subject_id, predicate, object_id[, source_drawer_id]) to add: no identical one is active."""
    key = ["subject_id", "predicate", "object_id"]
    if "source_drawer_id" not in edges.columns:
        edges = edges.withColumn("source_drawer_id", F.lit(None).cast("long"))
    wanted = edges.groupBy(*key).agg(F.min("source_drawer_id").alias("source_drawer_id"))
    fresh = new_rows(relationships, wanted, key, known=active_edges(relationships), first=first)
    at = F.lit(now).cast("long")
    return fresh.select("id", *key, F.lit(1.0).alias("confidence"), at.alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), "source_drawer_id", at.alias("created_at"))


def add_edges(relationships: DataFrame, edges: DataFrame, now: int, first: int | None = None) -> DataFrame:
    """relationships with the edges added where no identical one is active."""
    return relationships.unionByName(fresh_edges(relationships, edges, now, first))


def named_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of both ends. Entities may be many, so Spark picks the join by their size."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    o = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    return relationships.join(s, "subject_id").join(o, "object_id")


def query(relationships: DataFrame, entities: DataFrame, subject: str | None = None, predicate: str | None = None, limit: int = QUERY_ROWS) -> DataFrame:
    """The newest edges of a subject, of a predicate, of both or of all, expired ones too."""
    if predicate is not None:
        relationships = relationships.where(F.col("predicate") == predicate)
    rows = named_edges(relationships, entities)
    if subject is not None:
        rows = rows.where(F.col("subject") == subject)
    return rows.select("id", "subject", "predicate", "object", "confidence", "valid_from", "valid_until", "source_drawer_id").orderBy(
        F.desc("valid_from"), "id").limit(limit)


def as_of_join(probes: DataFrame, relationships: DataFrame, bucket: int | None = None) -> DataFrame:
    """probes (subject_id, at, and others) with every relationship of the subject that holds at the time: begun, and not ended.

    An interval is cut into the buckets of time that it touches, a probe lies in one, and both meet by subject and bucket, so
    Spark joins by a hash of both. An interval that hasn't ended ends with the last probe; one that lasts longer than
    LONG buckets is met in the subject's own lane instead, so that no row is copied more often than that. bucket: by default
    as long as an interval on average, so that all are cut into about two pieces each; it decides the cost, no result."""
    last = F.lit(probes.agg(F.max("at")).head()[0]).cast("long")
    held = relationships.withColumn("_end", F.least(F.coalesce(F.col("valid_until") - 1, last), last)).where(F.col("valid_from") <= F.col("_end"))
    if bucket is None:
        bucket = max(1, int(held.agg(F.avg(F.col("_end") - F.col("valid_from") + 1)).head()[0] or 1))
    first, stop = F.floor(F.col("valid_from") / bucket), F.floor(F.col("_end") / bucket)
    lanes = F.when(stop - first < LONG, F.sequence(first, stop)).otherwise(F.array(F.lit(None).cast("long")))
    cut = held.withColumn("_bucket", F.explode(lanes)).drop("_end")
    mine = probes.withColumn("_bucket", F.explode(F.array(F.floor(F.col("at") / bucket), F.lit(None).cast("long"))))
    both = mine.withColumn("_lane", F.coalesce("_bucket", F.lit(-(1 << 62)))).drop("_bucket").join(
        cut.withColumn("_lane", F.coalesce("_bucket", F.lit(-(1 << 62)))).drop("_bucket"), ["subject_id", "_lane"])
    return both.where((F.col("valid_from") <= F.col("at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("at")))).drop("_lane")


def as_of(relationships: DataFrame, entities: DataFrame, at: int) -> DataFrame:
    """Edges that hold at a time: begun, and not ended (an extension)."""
    held = relationships.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    return named_edges(held, entities).select("id", "subject", "predicate", "object", "confidence", "valid_from", "valid_until")
