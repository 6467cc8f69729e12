"""Queries of the inverted index (BM25) and the inverted file of vectors, over `documents`, `benchmark` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.ivf import IvfIndex
from tessera.operators.knn import knn, knn_join
from tessera.operators.shared import new_path
from tessera.operators.text_index import TextIndex, fused
from tessera.plans.base import SEARCH_TEXT, query, query_vector, stamp, table, vectors
from tessera.plans.vector_queries import E, K, l2, near_sql, shown

#: What the probes are chosen for on sampled rows, so that other rows, if few are asked for, keep to 0.95.
RECALL = 0.985
_PLACES: dict[tuple, object] = {}


def kept(spark, sf, name, source, make):
    """An index over a table, built once a session and again when the table's files change."""
    key = (spark.sparkContext.applicationId, sf, name, stamp(spark, f"{sf}/{source}.parquet"))
    if key not in _PLACES:
        _PLACES[key] = make(new_path(spark, name))
    return _PLACES[key]


def text_index(spark, sf) -> TextIndex:
    return kept(spark, sf, "text-index", "documents", lambda path: TextIndex.build(table(spark, sf, "documents"), path, "doc_id", "text"))


def vector_index(spark, sf) -> IvfIndex:
    return kept(spark, sf, "vector-index", "embeddings", lambda path: IvfIndex.build(vectors(spark, sf), path))


def bm25_sql(asked: str, k: int) -> str:
    """(query_id, id, score, rank) of the k best documents for each row of asked (query_id, text)."""
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
        WITH w AS (SELECT doc_id AS id, coalesce({words.format('text')}, []) AS words FROM documents),
        n AS (SELECT count(*)::DOUBLE AS docs, sum(len(words)) / count(*)::DOUBLE AS average FROM w),
        q AS (SELECT DISTINCT query_id, unnest({words.format('text')}) AS term FROM ({asked})),
        tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) + 0.0 AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, id)
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k}"""


ONE = f"SELECT 0 AS query_id, '{SEARCH_TEXT}' AS text"


@query(f"SELECT id, score FROM ({bm25_sql(ONE, K)})")
def bm25_search(spark, sf):
    """The K best documents for a text, of the postings of its words only."""
    return text_index(spark, sf).search(SEARCH_TEXT, K).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, id, score, rank FROM ({bm25_sql('SELECT item_id AS query_id, text FROM benchmark', 3)})")
def bm25_join(spark, sf):
    """The three best documents for each benchmark text."""
    found = text_index(spark, sf).search_join(table(spark, sf, "benchmark"), 3, query_id="item_id")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""
    WITH near AS (SELECT id, round(d, 6) + 0.0 AS distance, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT e.vec_id AS id, {l2('e.embedding', 'q')} AS d FROM {E}) QUALIFY rank <= {2 * K}),
    ranked AS (SELECT id, score AS bm25, rank FROM ({bm25_sql(ONE, 2 * K)}))
    SELECT id, distance, bm25, round(coalesce(1 / (60.0 + near.rank), 0) + coalesce(1 / (60.0 + ranked.rank), 0), 6) + 0.0 AS score FROM near FULL JOIN ranked USING (id)
    ORDER BY coalesce(1::DOUBLE / (60 + near.rank), 0) + coalesce(1::DOUBLE / (60 + ranked.rank), 0) DESC, id LIMIT {K}""")
def hybrid_bm25(spark, sf):
    """Nearest vectors and best texts, fused by their ranks."""
    near = knn(vectors(spark, sf), query_vector(spark, sf), 2 * K)
    found = fused(near, text_index(spark, sf).search(SEARCH_TEXT, 2 * K), K)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query(near_sql(l2("e.embedding", "q")))
def ivf_knn(spark, sf):
    """The search with as many probes as there are cells: the exact answer."""
    index = vector_index(spark, sf)
    return shown(index.knn(query_vector(spark, sf), K, probes=max(1, len(index.cells))))


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf):
    """Queries of every hundredth id against all vectors: whether the cells read, as many as sampled rows need for RECALL, have 0.95
    of the K nearest that the exact search finds."""
    asked, index = vectors(spark, sf).where("id % 100 = 0").withColumnRenamed("id", "query_id"), vector_index(spark, sf)
    exact = knn_join(asked, vectors(spark, sf), K).select("query_id", "id", F.lit(True).alias("wanted"))
    found = index.knn_join(asked, K, index.probes_for(RECALL, K)).select("query_id", "id", F.lit(True).alias("got"))
    hit = exact.join(found, ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), (F.count("got") >= 0.95 * F.count("wanted")).alias("recalled"))
