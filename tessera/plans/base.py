"""The registry's decorator, and views of the driver's tables in the shape of the memory store's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text
from tessera.operators.shared import new_path
from tessera.operators.versions import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EPOCH = 1704067200
NOW = EPOCH + 100 * 86400
SEARCH_TEXT = "That and onesen erblest it hein ti inenan"
UPPER, LOWER = text.UPPER, text.LOWER


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was last changed, and its length."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where)
    return status.getModificationTime(), status.getLen()


_STORES: dict[tuple, Store] = {}


def session_store(spark: SparkSession, sf: str) -> Store:
    """A store for the tables that come from those of sf: one a session, and a new one where they have changed."""
    key = (spark.sparkContext.applicationId, sf, *(stamp(spark, f"{sf}/{t}.parquet") for t in ("documents", "customer", "orders")))
    if key not in _STORES:
        _STORES[key] = Store(spark, new_path(spark, "store"), {name: schema.TABLES[name] for name in ("wings", "rooms", "drawers", "entities", "relationships")})
    return _STORES[key]


def built(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What make gives, written to the session's store once, and read from there."""
    held = session_store(spark, sf)
    if name not in held.state.parts:
        held.append(name, make(spark, sf))
    return held.table(name)


def query_vector(spark: SparkSession, sf: str) -> list:
    """The embedding of vec_id 0, which the queries search with."""
    row = vectors(spark, sf).where("id = 0").select("embedding").head()
    if row is None:
        raise ValueError("embeddings has no vec_id 0")
    return row[0]


def make_wings(spark: SparkSession, sf: str) -> DataFrame:
    """One per language; their few names are numbered in one window."""
    names = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("name IS NOT NULL")
    return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.lit("").alias("description"),
                        F.lit("project").alias("wing_type"), F.lit(EPOCH).cast("long").alias("created_at"), F.lit(EPOCH).cast("long").alias("updated_at"))


def make_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """One per language and source."""
    names = table(spark, sf, "documents").groupBy("lang", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("lang IS NOT NULL AND name IS NOT NULL")
    own = wings(spark, sf).select(F.col("id").alias("wing_id"), F.col("name").alias("lang"))
    return names.join(own, "lang").select(
        F.row_number().over(Window.orderBy("lang", "name")).cast("long").alias("id"), "wing_id", "name", F.lit("").alias("description"), F.lit(EPOCH).cast("long").alias("created_at"))


def make_drawers(spark: SparkSession, sf: str) -> DataFrame:
    """One per document."""
    own = rooms(spark, sf).select(F.col("id").alias("room_id"), "wing_id", F.col("name").alias("source")).join(
        wings(spark, sf).select(F.col("id").alias("wing_id"), F.col("name").alias("lang")), "wing_id").select("room_id", "source", "lang")
    return table(spark, sf, "documents").join(own, ["lang", "source"]).select(
        F.col("doc_id").alias("id"), "room_id", F.col("text").alias("content"), F.concat(F.lit("doc/"), "doc_id").alias("source_path"), F.lit("file").alias("source_type"),
        F.lit(0).alias("chunk_index"), text.content_hash(F.col("text")).alias("content_hash"), (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("created_at")).repartitionByRange("id").sortWithinPartitions("id")


def wings(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, "wings", make_wings)


def rooms(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, "rooms", make_rooms)


def drawers(spark: SparkSession, sf: str) -> DataFrame:
    """In order of their ids, so that a filter by id skips most of the files."""
    return built(spark, sf, "drawers", make_drawers)


HIER = """
wings AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL)),
rooms AS (SELECT row_number() OVER (ORDER BY lang, source) AS id, w.id AS wing_id, source AS name
          FROM (SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL) d JOIN wings w ON w.name = d.lang),
drawers AS (SELECT doc_id AS id, r.id AS room_id, text AS content, 'doc/' || doc_id AS source_path, sha256(text) AS content_hash, 1704067200 + doc_id * 3600 AS created_at
            FROM documents d JOIN wings w ON w.name = d.lang JOIN rooms r ON r.wing_id = w.id AND r.name = d.source)"""
PREVIEW = "substr(content, 1, list_max(list_filter(range(201), lambda n: strlen(substr(content, 1, n)) <= 200)))"


def chunk_sql(source: str, size: int, overlap: int) -> str:
    """(id, chunk_index, start, stop, chunk, content_hash) of the texts of source (id, text), a chunk a round: a window of the
    rest, up to its last blank line, else its last line feed, beyond its first quarter; the next begins `overlap` bytes before
    its end, further back where that is inside a character."""
    line = "regexp_extract(w, '(?s)^(.*{mark})', 1)"
    two, one = (line.format(mark=m) for m in (r"\n\n", r"\n"))
    found = f"CASE WHEN contains(w, chr(10) || chr(10)) THEN {two} WHEN contains(w, chr(10)) THEN {one} ELSE '' END"
    window = f"left(rest, list_max(list_filter(range({size + 1}), lambda n: strlen(left(rest, n)) <= {size})))"
    # a mark counts beyond the first quarter: what it ends has as many bytes more as the mark
    mark = "CASE WHEN contains(w, chr(10) || chr(10)) THEN 2 ELSE 1 END"
    chunk = f"(SELECT CASE WHEN strlen(f) - m > {size // 4} THEN f ELSE w END FROM (SELECT {found} AS f, {mark} AS m, w FROM (SELECT {window} AS w)))"
    keep = f"right(c, list_min(list_filter(range({overlap + 1}), lambda n: strlen(right(c, n)) >= {overlap})))"
    return f"""
        WITH RECURSIVE step AS (
            SELECT id, 0 AS chunk_index, 0::BIGINT AS start, text AS rest FROM ({source}) WHERE text IS NOT NULL
            UNION ALL
            SELECT id, chunk_index + 1, start + strlen(c) - strlen(kept), kept || substr(rest, length(c) + 1)
            FROM (SELECT *, {keep} AS kept FROM (SELECT *, {chunk} AS c FROM step WHERE strlen(rest) > {size})))
        SELECT id, chunk_index, start, start + strlen(c) AS stop, c AS chunk, sha256(c) AS content_hash
        FROM (SELECT id, chunk_index, start, CASE WHEN strlen(rest) <= {size} THEN rest ELSE {chunk} END AS c FROM step)"""


def make_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, and the few order priorities after them."""
    some = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderdate").alias("first"))
    kinds = some.select((F.row_number().over(Window.orderBy("name")) + F.lit(1_000_000_000)).cast("long").alias("id"), "name", F.lit("priority").alias("entity_type"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("entity_type"))
    at = F.lit(EPOCH).cast("long")
    return people.unionByName(kinds).withColumns({"first_seen": at, "last_seen": at})


def make_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """An edge per order; it ends when the customer's next order of that status begins."""
    kinds = entities(spark, sf).where("entity_type = 'priority'").select(F.col("id").alias("object_id"), F.col("name").alias("o_orderpriority"))
    rows = table(spark, sf, "orders").join(kinds, "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), F.concat(F.lit("placed_"), "o_orderstatus").alias("predicate"), "object_id",
        F.lit(1.0).alias("confidence"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("valid_from"))
    until = F.lead("valid_from").over(Window.partitionBy("subject_id", "predicate").orderBy("valid_from", "id"))
    return rows.withColumns({"valid_until": until, "source_drawer_id": F.lit(None).cast("long"), "created_at": F.col("valid_from")})


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, "entities", make_entities)


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, "relationships", make_relationships)


GRAPH = """
entities AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS entity_type FROM customer UNION ALL
             SELECT row_number() OVER (ORDER BY p) + 1000000000, p, 'priority' FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)),
relationships AS (
    SELECT o_orderkey AS id, o_custkey AS subject_id, 'placed_' || o_orderstatus AS predicate, e.id AS object_id, 1.0::DOUBLE AS confidence, CAST(epoch(o_orderdate) AS BIGINT) AS valid_from,
           lead(CAST(epoch(o_orderdate) AS BIGINT)) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS valid_until
    FROM orders JOIN entities e ON e.name = o_orderpriority AND e.entity_type = 'priority')"""
