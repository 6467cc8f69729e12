"""The recency digest: the newest texts of all wings or of one, as short previews within a budget of bytes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.search import named

MAX_DRAWERS, MAX_BYTES, PREVIEW_BYTES, IDENTITY_BYTES = 15, 3200, 200, 10 * 1024
NO_IDENTITY = "No identity configured. Create an identity file."


def newest(drawers: DataFrame, rooms: DataFrame, wings: DataFrame, wing: str | None = None, max_drawers: int = MAX_DRAWERS) -> DataFrame:
    """The newest drawers with their names. Only ids and times are ranked; the driver takes the ids of the max_drawers that
    stay, and they become a filter that reaches the scan for the texts."""
    if wing is not None:
        wings = wings.where(F.col("name") == wing)
    dims = rooms.select(F.col("id").alias("room_id"), "wing_id").join(wings.select(F.col("id").alias("wing_id")), "wing_id").select("room_id")
    top = drawers.select("id", "room_id", "created_at").join(dims, "room_id", "left_semi").orderBy(F.desc("created_at"), "id").limit(max_drawers)
    found = drawers.where(F.col("id").isin([r["id"] for r in top.select("id").collect()]))
    return named(found, rooms, wings).select("id", "content", "source_path", "room_name", "wing_name", "created_at")


def budgeted(rows: DataFrame, max_bytes: int = MAX_BYTES, preview: int = PREVIEW_BYTES) -> DataFrame:
    """Rows in order (newest first) while the bytes of the previews before them stay under max_bytes; empty texts are left
    out. Adds preview and preview_bytes. rows are few (see newest), so one window holds them."""
    rows = rows.where(F.octet_length("content") > 0).withColumn("preview", text.preview(F.col("content"), preview)).withColumn(
        "preview_bytes", F.octet_length(text.prefix_bytes(F.col("content"), preview)))
    before = Window.orderBy(F.desc("created_at"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bytes_before", F.coalesce(F.sum("preview_bytes").over(before), F.lit(0))).where(F.col("bytes_before") < max_bytes)


def footer(rows: DataFrame) -> DataFrame:
    """(moments, preview_bytes, tokens) of budgeted rows."""
    n = F.coalesce(F.sum("preview_bytes"), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("moments"), n.alias("preview_bytes"), F.floor(n / 4).alias("tokens"))


def lines(rows: DataFrame) -> DataFrame:
    """(digest): the lines of budgeted rows, in order, as one text."""
    line = F.concat(F.lit("- ["), "wing_name", F.lit("/"), "room_name", F.lit("] ("), "source_path", F.lit(") "), "preview", F.lit("\n"))
    each = F.struct((-F.col("created_at")).alias("o"), "id", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"]), "").alias("digest"))


def identity(path: str | None = None) -> str:
    """The first bytes of the identity file, or a placeholder."""
    path = path or os.path.join(os.path.expanduser("~"), ".tessera", "identity.txt")
    try:
        with open(path, "rb") as f:
            return f.read(IDENTITY_BYTES).decode("utf-8", "ignore") or NO_IDENTITY
    except OSError:
        return NO_IDENTITY


def wake_up(drawers: DataFrame, rooms: DataFrame, wings: DataFrame, wing: str | None = None, *, max_drawers: int = MAX_DRAWERS, max_bytes: int = MAX_BYTES,
            preview: int = PREVIEW_BYTES, identity_path: str | None = None) -> str:
    """The digest as text: identity, lines, footer."""
    head = f"## L0 — IDENTITY\n{identity(identity_path)}\n\n## L1 — ESSENTIAL STORY\n"
    rows = budgeted(newest(drawers, rooms, wings, wing, max_drawers), max_bytes, preview).orderBy(F.desc("created_at"), "id").collect()
    if not rows:
        return head + "Palace is empty. Mine a directory first.\n"
    body = "".join(f"- [{r.wing_name}/{r.room_name}] ({r.source_path}) {r.preview}\n" for r in rows)
    return f"{head}{body}\n({len(rows)} moments loaded, ~{sum(r.preview_bytes for r in rows) // 4} tokens)\n"
