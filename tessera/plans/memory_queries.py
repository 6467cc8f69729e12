"""Queries of the memory store: search, listing, digest, statistics, writes, knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import digest, graph, search, store
from tessera.operators.knn import knn
from tessera.operators.shared import new_path
from tessera.palace import Palace
from tessera.plans.base import (EPOCH, GRAPH, HIER, LOWER, NOW, PREVIEW, SEARCH_TEXT, UPPER, chunk_sql, drawers, entities, query, query_vector, relationships, rooms,
                                session_store, table, vectors, wings)
from tessera.plans.vector_queries import l2
from tessera.sources import mining

WORDS = text.keyword_list(SEARCH_TEXT)
SHARE = "(" + " + ".join(f"CAST(contains(translate(content, '{UPPER}', '{LOWER}'), '{w.lower()}') AS INT)" for w in WORDS) + f") / {len(WORDS)}.0::DOUBLE"
RECENCY = f"(1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({NOW} - created_at) / 7776000.0::DOUBLE)))"
NEAR = f"near AS (SELECT vec_id AS id, {l2('embedding', 'q')} AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY distance, id LIMIT 40)"
NAMED = "drawers d JOIN rooms r ON r.id = d.room_id JOIN wings w ON w.id = r.wing_id"


def store_of(spark, sf):
    return drawers(spark, sf), rooms(spark, sf), wings(spark, sf)


@query(f"""WITH {HIER}, {NEAR}, found AS (SELECT n.id, content, source_path, w.name AS wing_name, r.name AS room_name, distance, created_at FROM near n JOIN drawers d ON d.id = n.id
    JOIN rooms r ON r.id = d.room_id JOIN wings w ON w.id = r.wing_id), scored AS (SELECT *, distance - 0.1 * {RECENCY} - 0.2 * {SHARE} AS s FROM found)
    SELECT id, source_path, wing_name, room_name, round(distance, 6) + 0.0 AS distance, round(s, 6) + 0.0 AS score, created_at FROM scored ORDER BY s, distance, id LIMIT 20""")
def hybrid_search(spark, sf):
    d, r, w = store_of(spark, sf)
    out = search.hybrid(vectors(spark, sf), d, r, w, SEARCH_TEXT, query_vector(spark, sf), limit=20, now=NOW)
    return out.select("id", "source_path", "wing_name", "room_name", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "created_at")


@query(f"WITH {HIER}, {NEAR} SELECT n.id, content, source_path, w.name AS wing_name, r.name AS room_name, round(distance, 6) + 0.0 AS distance, created_at FROM near n JOIN {NAMED} ON d.id = n.id")
def search_join(spark, sf):
    near = knn(vectors(spark, sf), query_vector(spark, sf), 40)
    return search.search_join(near, *store_of(spark, sf)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {HIER} SELECT id, round({SHARE}, 6) + 0.0 AS share FROM drawers")
def keyword_score(spark, sf):
    return drawers(spark, sf).select("id", F.round(text.keyword_share(F.col("content"), WORDS), 6).alias("share"))


@query(f"WITH {HIER} SELECT id, round({RECENCY}, 6) + 0.0 AS recency FROM drawers")
def recency_score(spark, sf):
    return drawers(spark, sf).select("id", F.round(text.recency(F.col("created_at"), NOW), 6).alias("recency"))


@query(f"WITH {HIER} SELECT id, name FROM wings ORDER BY name")
def list_wings(spark, sf):
    return wings(spark, sf).select("id", "name").orderBy("name")


@query(f"WITH {HIER} SELECT r.id, r.name FROM rooms r JOIN wings w ON w.id = r.wing_id WHERE w.name = 'de' ORDER BY r.name")
def list_rooms(spark, sf):
    own = wings(spark, sf).where("name = 'de'").select(F.col("id").alias("wing_id"))
    return rooms(spark, sf).join(own, "wing_id", "left_semi").select("id", "name").orderBy("name")


NEWEST = f"newest AS (SELECT d.id, content, source_path, r.name AS room_name, w.name AS wing_name, created_at FROM {NAMED} ORDER BY created_at DESC, d.id LIMIT 15)"
BUDGET = f"""shown AS (SELECT *, {PREVIEW} AS p FROM newest WHERE strlen(content) > 0),
    budget AS (SELECT * FROM (SELECT *, coalesce(sum(strlen(p)) OVER (ORDER BY created_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown) WHERE before < 1000)"""
LINES = "'- [' || wing_name || '/' || room_name || '] (' || source_path || ') ' || p || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END || chr(10)"


def budget(spark, sf):
    """The newest within 1000 bytes, so that the budget ends before the rows do."""
    return digest.budgeted(digest.newest(*store_of(spark, sf)), 1000)


@query(f"WITH {HIER}, {NEWEST} SELECT * FROM newest")
def wakeup_rows(spark, sf):
    return digest.newest(*store_of(spark, sf))


@query(f"WITH {HIER}, {NEWEST}, {BUDGET} SELECT id, p || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END AS preview, CAST(strlen(p) AS INT) AS preview_bytes, CAST(before AS BIGINT) AS bytes_before FROM budget")
def wakeup_budget(spark, sf):
    return budget(spark, sf).select("id", "preview", "preview_bytes", "bytes_before")


@query(f"WITH {HIER}, {NEWEST}, {BUDGET} SELECT count(*) AS moments, CAST(sum(strlen(p)) AS BIGINT) AS preview_bytes, CAST(floor(sum(strlen(p)) / 4) AS BIGINT) AS tokens FROM budget")
def wakeup_footer(spark, sf):
    return digest.footer(budget(spark, sf))


@query(f"WITH {HIER}, {NEWEST}, {BUDGET} SELECT string_agg({LINES}, '' ORDER BY created_at DESC, id) AS digest FROM budget")
def wakeup_digest(spark, sf):
    return digest.lines(budget(spark, sf))


@query(f"WITH {HIER} SELECT doc_id AS id, {PREVIEW} || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END AS preview FROM (SELECT doc_id, text AS content FROM documents)")
def preview(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.preview(F.col("text")).alias("preview"))


@query(f"WITH {HIER}, {GRAPH} SELECT (SELECT count(*) FROM wings) AS wings, (SELECT count(*) FROM rooms) AS rooms, (SELECT count(*) FROM drawers) AS drawers, (SELECT count(*) FROM entities) AS entities")
def palace_stats(spark, sf):
    """Counts of the store's log, once its tables are written; no data file is read for them."""
    store_of(spark, sf), entities(spark, sf)
    held, names = session_store(spark, sf), ("wings", "rooms", "drawers", "entities")
    return spark.createDataFrame([tuple(held.rows(t) for t in names)], ", ".join(f"{t} long" for t in names))


@query(f"WITH {HIER} SELECT w.name AS wing_name, r.name AS room_name, count(*) AS drawers FROM {NAMED} GROUP BY ROLLUP (w.name, r.name)")
def drawers_by_wing_rollup(spark, sf):
    return store.by_wing_and_room(*store_of(spark, sf))


@query(f"WITH {HIER} SELECT min(id) AS id, content_hash FROM drawers GROUP BY content_hash")
def dedup_drawers(spark, sf):
    return store.dedup(drawers(spark, sf)).select("id", "content_hash")


@query(f"""WITH {HIER}, stored AS (SELECT d.* FROM {NAMED} WHERE w.name = 'en'), old AS (SELECT content_hash, min(id) AS old FROM stored GROUP BY 1), new AS (SELECT content_hash, min(id) AS new FROM drawers GROUP BY 1)
    SELECT d.id, coalesce(old, new) AS stored_id, old IS NULL AND d.id = new AS inserted FROM drawers d JOIN new USING (content_hash) LEFT JOIN old USING (content_hash)""")
def insert_drawer_dedup(spark, sf):
    """All drawers are offered to a store that holds those of one wing."""
    d, r, w = store_of(spark, sf)
    stored = search.named(d, r, w).where("wing_name = 'en'")
    return store.resolved(d, stored)


@query(f"""WITH {HIER}, wanted AS (SELECT DISTINCT source AS name FROM documents UNION SELECT name FROM wings), fresh AS (SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM wings))
    SELECT id, name FROM wings UNION ALL SELECT row_number() OVER (ORDER BY name) + (SELECT max(id) FROM wings), name FROM fresh WHERE name IS NOT NULL""")
def upsert_wings(spark, sf):
    """The sources as wings beside the languages."""
    own = wings(spark, sf)
    wanted = table(spark, sf, "documents").select(F.col("source").alias("name")).where("name IS NOT NULL").union(own.select("name"))
    return store.upsert_wings(own, wanted.withColumns({"description": F.lit(""), "wing_type": F.lit("auto-mined")}), NOW).select("id", "name")


@query(f"""WITH {HIER}, wanted AS (SELECT id AS wing_id, 'notes' AS name FROM wings UNION SELECT wing_id, name FROM rooms), fresh AS (SELECT * FROM wanted EXCEPT SELECT wing_id, name FROM rooms)
    SELECT id, wing_id, name FROM rooms UNION ALL SELECT row_number() OVER (ORDER BY wing_id, name) + (SELECT max(id) FROM rooms), wing_id, name FROM fresh""")
def upsert_rooms(spark, sf):
    """A room for notes in each wing beside the rooms there are."""
    own = rooms(spark, sf)
    wanted = own.select("wing_id", "name").union(wings(spark, sf).select("id", F.lit("notes")))
    return store.upsert_rooms(own, wanted.withColumn("description", F.lit("")), NOW).select("id", "wing_id", "name")


@query(f"""WITH {GRAPH}, seen AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT s_name FROM supplier), top AS (SELECT max(id) AS m FROM entities)
    SELECT id, name, CASE WHEN name IN (SELECT name FROM seen) THEN {NOW} ELSE {EPOCH} END AS last_seen FROM entities UNION ALL
    SELECT row_number() OVER (ORDER BY name) + m, name, {NOW} FROM seen, top WHERE name NOT IN (SELECT name FROM entities)""")
def upsert_entities(spark, sf):
    """Priorities and suppliers are seen; the former are known."""
    seen = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.lit("priority").alias("entity_type")).union(
        table(spark, sf, "supplier").select("s_name", F.lit("supplier")))
    return graph.upsert_entities(entities(spark, sf), seen, NOW).select("id", "name", "last_seen")


@query(f"""WITH {GRAPH}, wanted AS (SELECT DISTINCT subject_id, predicate, object_id FROM relationships),
    fresh AS (SELECT * FROM wanted EXCEPT SELECT subject_id, predicate, object_id FROM relationships WHERE valid_until IS NULL)
    SELECT id, subject_id, predicate, object_id, valid_from, valid_until FROM relationships UNION ALL
    SELECT row_number() OVER (ORDER BY subject_id, predicate, object_id) + (SELECT max(id) FROM relationships), subject_id, predicate, object_id, {NOW}, NULL FROM fresh""")
def kg_add_edge(spark, sf):
    """Every edge is offered again: active ones stay, ended ones begin anew."""
    rows = relationships(spark, sf)
    return graph.add_edges(rows, rows.select("subject_id", "predicate", "object_id"), NOW).select("id", "subject_id", "predicate", "object_id", "valid_from", "valid_until")


EDGES = "SELECT r.id, s.name AS subject, predicate, o.name AS object, confidence, valid_from, valid_until FROM relationships r JOIN entities s ON s.id = subject_id JOIN entities o ON o.id = object_id"


@query(f"WITH {GRAPH} {EDGES} WHERE s.name = 'Customer#000000007' AND predicate = 'placed_O' ORDER BY valid_from DESC, r.id LIMIT 100")
def kg_query(spark, sf):
    return graph.query(relationships(spark, sf), entities(spark, sf), "Customer#000000007", "placed_O").drop("source_drawer_id")


@query(f"WITH {GRAPH} SELECT id, subject_id, predicate, object_id, valid_from FROM relationships WHERE valid_until IS NULL")
def kg_active_edges(spark, sf):
    return graph.active_edges(relationships(spark, sf)).select("id", "subject_id", "predicate", "object_id", "valid_from")


@query(f"WITH {GRAPH} {EDGES} WHERE valid_from <= 883612800 AND (valid_until IS NULL OR valid_until > 883612800)")
def kg_as_of(spark, sf):
    return graph.as_of(relationships(spark, sf), entities(spark, sf), 883612800)


@query(f"""WITH {HIER}, kept AS (SELECT d.id AS drawer, r.id AS room, w.id AS wing FROM {NAMED} WHERE w.name <> 'fr')
    SELECT 'wing' AS kind, id FROM wings WHERE name <> 'fr' UNION ALL SELECT 'room', r.id FROM rooms r JOIN wings w ON w.id = r.wing_id WHERE w.name <> 'fr'
    UNION ALL SELECT 'drawer', drawer FROM kept UNION ALL SELECT 'vector', vec_id FROM embeddings WHERE vec_id IN (SELECT drawer FROM kept)""")
def cascade_delete(spark, sf):
    """What is left of all four tables after a wing is deleted."""
    d, r, w = store_of(spark, sf)
    left = store.cascade(w, r, d, vectors(spark, sf), F.col("name") == "fr")
    parts = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")) for kind, df in zip(("wing", "room", "drawer", "vector"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def files(spark, sf):
    """The documents as files: one folder per source, names with and without extensions to skip."""
    ends = [".md", ".py", ".png", "", ".PNG", ".lock", ".txt"]
    name = F.concat(F.when(F.col("doc_id") % 13 == 0, ".f").otherwise("f"), "doc_id", F.array(*[F.lit(e) for e in ends])[(F.col("doc_id") % len(ends)).cast("int")])
    docs = table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("project/"), "source", F.lit("/"), name).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))


NAMES = """names AS (SELECT doc_id, text, (CASE WHEN doc_id % 13 = 0 THEN '.f' ELSE 'f' END) || doc_id || (['.md', '.py', '.png', '', '.PNG', '.lock', '.txt'])[1 + doc_id % 7] AS name FROM documents)"""
SKIP = "(doc_id % 13 = 0 OR doc_id % 7 IN (2, 4, 5))"


@query(f"WITH {NAMES} SELECT 'project/' || source || '/' || name AS path, {SKIP} AS skipped FROM names JOIN documents USING (doc_id)")
def file_filter(spark, sf):
    return files(spark, sf).select("path", text.should_skip(text.basename(F.col("path"))).alias("skipped"))


@query(f"""WITH {NAMES} SELECT 'project/' || source || '/' || name AS path,
    ((name LIKE '%.py' AND name NOT LIKE 'f7%') OR source = 'web' OR name LIKE 'f_.md') AND name <> 'f14.md' AS ignored FROM names JOIN documents USING (doc_id)""")
def ignored_files(spark, sf):
    """Files that globs of an ignore file leave out: by ending, but some; a folder; by a sign; and one taken in again."""
    globs = ["*.py", "!f7*.py", "/project/web/", "# no glob", "f?.md", "!project/**/f14.md"]
    return files(spark, sf).select("path", text.ignored(F.col("path"), globs).alias("ignored"))


@query("SELECT doc_id AS id, strlen(text) BETWEEN 1 AND 10485760 AS fits FROM documents")
def size_filter(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.size_fits(F.octet_length("text")).alias("fits"))


@query(f"""WITH {NAMES} SELECT count(*) FILTER (WHERE NOT {SKIP} AND strlen(text) > 0) AS files_processed, count(*) FILTER (WHERE {SKIP} OR strlen(text) = 0) AS files_skipped,
    CAST(coalesce(sum(strlen(text)) FILTER (WHERE NOT {SKIP}), 0) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE NOT {SKIP} AND strlen(text) > 0 AND text IS NULL) AS errors FROM names""")
def mine_stats(spark, sf):
    return mining.stats(files(spark, sf))


MINED = "SELECT source || '/' || name AS id, n.text FROM names n JOIN documents USING (doc_id)"


@query(f"""WITH {NAMES} SELECT 'project' AS room, id AS source_path, 'file' AS source_type, chunk_index, start, stop AS end, content_hash
    FROM ({chunk_sql(f"{MINED} WHERE NOT {SKIP} AND strlen(n.text) BETWEEN 1 AND 10485760", text.MAX_CHUNK, text.OVERLAP)})""")
def mine_directory(spark, sf):
    """The chunks of all files that aren't skipped, ready for the store."""
    return mining.file_chunks(files(spark, sf), "project", text.MAX_CHUNK, text.OVERLAP).withColumn("content_hash", text.content_hash(F.col("content"))).drop("content")


@query(f"""WITH {NAMES} SELECT parse_filename(id) AS room, 'project/' || id AS source_path, 'file' AS source_type, chunk_index, start, stop AS end, chunk AS content
    FROM ({chunk_sql(f"{MINED} ORDER BY strlen(n.text) DESC, 'project/' || source || '/' || name LIMIT 1", text.MAX_CHUNK, text.OVERLAP)})""")
def mine_file(spark, sf):
    """The chunks of the longest document, as one file."""
    longest = files(spark, sf).orderBy(F.desc("length"), "path").limit(1)
    return mining.file_chunks(longest, None, text.MAX_CHUNK, text.OVERLAP, every=True)


@query("SELECT 1 AS chunks, sha256('a decision and its reason') AS content_hash, 'notes' AS room, 'agent' AS source_path, 'memory' AS source_type")
def store_memory(spark, sf):
    """A text stored twice in a new store, read back from its tables."""
    palace = Palace.open(spark, new_path(spark, "palace"), dim=16)
    for now in (EPOCH, NOW):
        palace.store("a decision and its reason", "work", now=now)
    rows = palace.table("drawers").join(palace.table("rooms").select(F.col("id").alias("room_id"), F.col("name").alias("room")), "room_id").join(palace.table("vec_drawers"), "id")
    return rows.groupBy("content_hash", "room", "source_path", "source_type").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
