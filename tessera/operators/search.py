"""Hybrid search: nearest vectors, joined with their texts, re-ranked by recency and keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.knn import knn

LIMIT, RECENCY_BOOST, KEYWORD_BOOST, RERANK_BONUS, RERANK_BYTES = 20, 0.1, 0.2, 0.5, 500


def named(drawers: DataFrame, rooms: DataFrame, wings: DataFrame) -> DataFrame:
    """drawers with room_name and wing_name; those without a room or wing vanish. No side is marked for a broadcast: Spark
    broadcasts rooms and wings while their size, as known from the files or measured at run time, is under its threshold."""
    names = rooms.select(F.col("id").alias("room_id"), F.col("name").alias("room_name"), "wing_id").join(
        wings.select(F.col("id").alias("wing_id"), F.col("name").alias("wing_name")), "wing_id")
    return drawers.join(names, "room_id")


def search_join(near: DataFrame, drawers: DataFrame, rooms: DataFrame, wings: DataFrame) -> DataFrame:
    """Nearest (id, distance) with text and names. They are at most 2 * 4096 rows by the bound on k, so the driver takes them
    and their ids become a filter that reaches the scan of the drawers."""
    near = near.select("id", "distance")
    held = near.collect()
    few = near.sparkSession.createDataFrame(held, near.schema)
    found = drawers.where(F.col("id").isin([r["id"] for r in held])).join(F.broadcast(few), "id")
    return named(found, rooms, wings).select("id", "content", "source_path", "wing_name", "room_name", "distance", "created_at")


def score(distance: Column, content: Column, created_at: Column, query: str, now: int, recency_boost: float = RECENCY_BOOST,
          keyword_boost: float = KEYWORD_BOOST) -> Column:
    """distance less the boosts; lower is better."""
    return distance - F.lit(recency_boost) * text.recency(created_at, now) - F.lit(keyword_boost) * text.keyword_share(content, text.keyword_list(query))


def hybrid(vectors: DataFrame, drawers: DataFrame, rooms: DataFrame, wings: DataFrame, query: str, query_vector: list, *, limit: int = LIMIT, now: int,
           recency_boost: float = RECENCY_BOOST, keyword_boost: float = KEYWORD_BOOST, metric: str = "l2", reranker: Callable[[str, str], bool] | None = None) -> DataFrame:
    """The best `limit` of the 2 * limit nearest drawers: id, content, source_path, wing_name, room_name, distance, created_at, score.

    reranker(query, first 500 bytes of a text) may lower the score of what it takes for relevant by 0.5; it runs on
    the driver over the 2 * limit candidates, and its errors are ignored."""
    near = knn(vectors, query_vector, 2 * limit, metric=metric).select("id", "distance")
    found = search_join(near, drawers, rooms, wings)
    found = found.withColumn("score", score(F.col("distance"), F.col("content"), F.col("created_at"), query, now, recency_boost, keyword_boost))
    if reranker is not None:
        found = _reranked(found, query, reranker)
    return found.orderBy("score", "distance", "id").limit(limit)


def _reranked(found: DataFrame, query: str, reranker: Callable[[str, str], bool]) -> DataFrame:
    def relevant(content: str) -> bool:
        try:
            return bool(reranker(query, content))
        except Exception:  # noqa: BLE001  an optional service that fails changes nothing
            return False

    short = found.select("id", text.prefix_bytes(F.col("content"), RERANK_BYTES).alias("content")).collect()
    chosen = [r["id"] for r in short if relevant(r["content"] or "")]
    return found.withColumn("score", F.col("score") - F.when(F.col("id").isin(chosen), F.lit(RERANK_BONUS)).otherwise(F.lit(0.0)))
