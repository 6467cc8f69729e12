"""Writes as DataFrames: get-or-create by natural key, deduplicated insert, update, delete, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.numbering import numbered


def next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).head()[0] or 0) + 1


def new_rows(table: DataFrame, wanted: DataFrame, key: list[str], known: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """The rows of wanted (one per key) whose key known (or table) lacks, with ids from `first` on, else from where table's
    end, in key order. Null keys match null keys."""
    have = (known if known is not None else table).select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = wanted.join(have, same, "left_anti")
    return numbered(fresh, [F.col(k) for k in key], "id", next_id(table) if first is None else first)


def fresh_wings(wings: DataFrame, wanted: DataFrame, now: int, first: int | None = None) -> DataFrame:
    """The wings of wanted (name, description, wing_type) that wings lacks."""
    rows = wanted.groupBy("name").agg(F.min("description").alias("description"), F.min("wing_type").alias("wing_type"))
    at = F.lit(now).cast("long")
    return new_rows(wings, rows, ["name"], first=first).select("id", "name", "description", "wing_type", at.alias("created_at"), at.alias("updated_at"))


def upsert_wings(wings: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """wings with those of wanted (name, description, wing_type) that they lack."""
    return wings.unionByName(fresh_wings(wings, wanted, now))


def fresh_rooms(rooms: DataFrame, wanted: DataFrame, now: int, first: int | None = None) -> DataFrame:
    """The rooms of wanted (wing_id, name, description) that rooms lacks."""
    rows = wanted.groupBy("wing_id", "name").agg(F.min("description").alias("description"))
    return new_rows(rooms, rows, ["wing_id", "name"], first=first).select("id", "wing_id", "name", "description", F.lit(now).cast("long").alias("created_at"))


def upsert_rooms(rooms: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """rooms with those of wanted (wing_id, name, description) that they lack."""
    return rooms.unionByName(fresh_rooms(rooms, wanted, now))


def first_of_hash(drawers: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """One drawer of each content hash, the first by order (id). A minimum per hash is a partial aggregate, so a text
    that a third of all rows share is no hot group; only one row per hash is joined back. A null hash (no content) is a
    hash like any other."""
    order = order or ["id"]
    firsts = drawers.groupBy(F.col("content_hash").alias("_hash")).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.col("content_hash").eqNullSafe(F.col("_hash")) & F.struct(*order).eqNullSafe(F.col("_first"))
    return drawers.join(firsts, same, "left_semi")


def dedup(drawers: DataFrame, stored: DataFrame | None = None, order: list[Column | str] | None = None) -> DataFrame:
    """The drawers to insert: the first of each hash, unless stored has the hash, in any wing or room."""
    if stored is None:
        return first_of_hash(drawers, order)
    have = stored.select(F.col("content_hash").alias("_have")).distinct()
    fresh = drawers.join(have, F.col("content_hash").eqNullSafe(F.col("_have")), "left_anti")
    return first_of_hash(fresh, order)


def resolved(drawers: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, stored_id, inserted) for every drawer offered: the id under which its text is stored. No content is a content too."""
    have = stored.groupBy(F.col("content_hash").alias("_h")).agg(F.min("id").alias("_old"))
    new = drawers.groupBy(F.col("content_hash").alias("_hash")).agg(F.min("id").alias("_new"))
    at = new.join(have, F.col("_hash").eqNullSafe(F.col("_h")), "left").select("_hash", F.coalesce("_old", "_new").alias("stored_id"), F.col("_old").isNull().alias("_fresh"))
    return drawers.select("id", "content_hash").join(at, F.col("content_hash").eqNullSafe(F.col("_hash"))).select(
        "id", "stored_id", (F.col("_fresh") & (F.col("id") == F.col("stored_id"))).alias("inserted"))


def updated(table: DataFrame, changes: DataFrame, key: str = "id", fixed: tuple[str, ...] = ()) -> DataFrame:
    """table with the values of changes (key and some of its columns); null means unchanged, unknown keys do nothing.
    The key and the columns in `fixed` (partition keys) can't be changed."""
    columns = [c for c in changes.columns if c != key]
    if bad := set(columns) & set(fixed) or set(columns) - set(table.columns):
        raise ValueError(f"can't update {sorted(bad)}")
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def deleted(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """table without the rows of ids; unknown ids do nothing."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def cascade(wings: DataFrame, rooms: DataFrame, drawers: DataFrame, vectors: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables after the wings that meet a condition are deleted, with their rooms, drawers and vectors."""
    kept = wings.where(~gone)
    left = rooms.join(kept.select(F.col("id").alias("wing_id")), "wing_id", "left_semi")
    held = drawers.join(left.select(F.col("id").alias("room_id")), "room_id", "left_semi")
    return kept, left, held, vectors.join(held.select("id"), "id", "left_semi")


def latest_per_partition(table: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    return table.groupBy(*keys).agg(F.max(id_col).alias("latest_id"))


def by_wing_and_room(drawers: DataFrame, rooms: DataFrame, wings: DataFrame) -> DataFrame:
    """Drawers by wing and room with subtotals (an extension)."""
    from tessera.operators.search import named

    return named(drawers.select("id", "room_id"), rooms, wings).rollup("wing_name", "room_name").agg(F.count(F.lit(1)).alias("drawers"))


def drawer_rows(content: DataFrame, max_id: int, order: list[Column]) -> DataFrame:
    """content (room_id, content, source_path, source_type, chunk_index, created_at) with ids and hashes."""
    rows = content.withColumn("content_hash", text.content_hash(F.col("content")))
    return numbered(rows, order, "id", max_id + 1)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
