"""Queries of vector functions, nearest neighbours and vector tables, over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vector as vec
from tessera.operators import store
from tessera.operators.knn import knn, knn_join, literal, static_vectors
from tessera.operators.shared import new_path
from tessera.operators.vector_table import VectorTable, VectorTableSpec, appended
from tessera.plans.base import query, query_vector, stamp, table, vectors

Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
E = "embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
K = 10


def zipped(a: str, b: str, body: str) -> str:
    return f"list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: {body})"


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum({zipped(a, b, '(z[1] - z[2]) * (z[1] - z[2])')}))"


def l1(a: str, b: str) -> str:
    return f"list_sum({zipped(a, b, 'abs(z[1] - z[2])')})"


def dot(a: str, b: str) -> str:
    return f"list_sum({zipped(a, b, 'z[1] * z[2]')})"


def cosine(a: str, b: str) -> str:
    return f"(1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def rounded(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def as_json(v: str) -> str:
    return f"'[' || array_to_string(list_transform({v}, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']'"


INT8 = "list_transform({}::DOUBLE[], lambda x: CAST(trunc(greatest(-128, least(127, (x + 1) / CAST(CAST(2.0 / 255.0 AS FLOAT) AS DOUBLE) - 128))) AS INT))"


def near_sql(distance: str, where: str = "TRUE", source: str = "embeddings", k: int = K) -> str:
    return f"""SELECT id, label, round(d, 6) + 0.0 AS distance FROM (
        SELECT e.vec_id AS id, e.label, {distance} AS d FROM {source} e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE {where}) ORDER BY d, id LIMIT {k}"""


def shown(df):
    return df.select("id", "label", F.round("distance", 6).alias("distance"))


def nearest(spark, sf, **kw):
    return shown(knn(vectors(spark, sf), query_vector(spark, sf), K, **kw))


@query(near_sql(l2("e.embedding", "q")))
def knn_l2(spark, sf):
    return nearest(spark, sf)


@query(near_sql(l1("e.embedding", "q")))
def knn_l1(spark, sf):
    return nearest(spark, sf, metric="l1")


@query(near_sql(cosine("e.embedding", "q")))
def knn_cosine(spark, sf):
    return nearest(spark, sf, metric="cosine")


@query(near_sql(l2(INT8.format("e.embedding"), INT8.format("q"))))
def knn_int8(spark, sf):
    q = vectors(spark, sf).where("id = 0").select(vec.quantize_int8(F.col("embedding"))).head()[0]
    return shown(knn(vectors(spark, sf).withColumn("embedding", vec.quantize_int8(F.col("embedding"))), q, K))


@query(near_sql("len(list_filter(list_zip(e.embedding, q), lambda z: (z[1] > 0) <> (z[2] > 0)))"))
def knn_hamming(spark, sf):
    q = vectors(spark, sf).where("id = 0").select(vec.quantize_binary(F.col("embedding"))).head()[0]
    return shown(knn(vectors(spark, sf).withColumn("embedding", vec.quantize_binary(F.col("embedding"))), q, K, metric="hamming"))


@query(near_sql(l2("e.embedding", "q"), "e.label = 3"))
def knn_meta_eq(spark, sf):
    return nearest(spark, sf, where={"label": ("=", 3)})


def with_documents(spark, sf):
    return vectors(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"), "id")


WITH_DOCUMENTS = "(SELECT vec_id, embedding, label, lang, n_chars FROM embeddings JOIN documents ON vec_id = doc_id)"


@query(near_sql(l2("e.embedding", "q"), "n_chars >= 1000 AND label < 8", WITH_DOCUMENTS))
def knn_meta_range(spark, sf):
    return shown(knn(with_documents(spark, sf), query_vector(spark, sf), K, where={"n_chars": (">=", 1000), "label": ("<", 8)}))


@query(near_sql(l2("e.embedding", "q"), "lang IN ('de', 'fr')", WITH_DOCUMENTS))
def knn_meta_in(spark, sf):
    return shown(knn(with_documents(spark, sf), query_vector(spark, sf), K, where={"lang": ("in", ["de", "fr"])}))


@query(near_sql(l2("e.embedding", "q"), "lang <> 'en'", WITH_DOCUMENTS))
def knn_meta_ne(spark, sf):
    return shown(knn(with_documents(spark, sf), query_vector(spark, sf), K, where={"lang": ("!=", "en")}))


@query(near_sql(l2("e.embedding", "q"), "good", "(SELECT vec_id, embedding, label, quality = 1 AS good FROM embeddings JOIN labels ON vec_id = doc_id)"))
def knn_meta_bool(spark, sf):
    rows = vectors(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good")), "id")
    return shown(knn(rows, query_vector(spark, sf), K, where={"good": ("=", True)}))


@query(near_sql(l2("e.embedding", "q"), "n_chars >= 500 AND n_chars < 3000", WITH_DOCUMENTS))
def knn_meta_between(spark, sf):
    """Two bounds on one column."""
    return shown(knn(with_documents(spark, sf), query_vector(spark, sf), K, where=[("n_chars", ">=", 500), ("n_chars", "<", 3000)]))


@query(f"""SELECT id, label, round(d, 6) + 0.0 AS distance, {as_json('v')} AS vector FROM (
    SELECT e.vec_id AS id, e.label, e.embedding AS v, {l2('e.embedding', 'q')} AS d FROM {E}) ORDER BY d, id LIMIT {K}""")
def knn_with_vector(spark, sf):
    near = knn(vectors(spark, sf), query_vector(spark, sf), K, with_vector=True)
    return near.select("id", "label", F.round("distance", 6).alias("distance"), vec.to_json(F.col("embedding")).alias("vector"))


SPEC = VectorTableSpec(vectors={"embedding": ("float32", 64)}, partition={"label": "int"})
_TABLES: dict[tuple, str] = {}


def vector_table(spark, sf):
    """The embeddings as a vector table with a folder for each label, written once a session."""
    key = (spark.sparkContext.applicationId, sf, stamp(spark, f"{sf}/embeddings.parquet"))
    made = key in _TABLES
    out = VectorTable(spark, _TABLES.setdefault(key, new_path(spark, "vector-table")), SPEC)
    if not made:
        out.insert(vectors(spark, sf).withColumn("label", F.col("label").cast("long")))
    return out


def in_partitions(spark, sf, op, label):
    rows = vector_table(spark, sf).knn(query_vector(spark, sf), K, where={"label": (op, label)})
    return shown(rows.withColumn("label", F.col("label").cast(vectors(spark, sf).schema["label"].dataType)))


@query(near_sql(l2("e.embedding", "q"), "label = 5"))
def knn_partition_eq(spark, sf):
    return in_partitions(spark, sf, "=", 5)


@query(near_sql(l2("e.embedding", "q"), "label <= 4"))
def knn_partition_range(spark, sf):
    return in_partitions(spark, sf, "<=", 4)


@query(near_sql(l2("e.embedding", "q"), "label IN (SELECT label FROM embeddings WHERE vec_id % 500 = 7)"))
def knn_partition_in_query(spark, sf):
    """Partition values that another query gives: folders are pruned at run time."""
    wanted = vectors(spark, sf).where("id % 500 = 7").select("label")
    return in_partitions(spark, sf, "in", wanted)


@query(near_sql(l2("e.embedding", "q"), "e.vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def knn_id_in(spark, sf):
    return nearest(spark, sf, ids=table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


@query(near_sql(l2("e.embedding", "q"), f"{l2('e.embedding', 'q')} < 1.2"))
def knn_distance_lt(spark, sf):
    return nearest(spark, sf, distance=("<", 1.2))


@query(near_sql(l2("e.embedding", "q"), f"{l2('e.embedding', 'q')} > 1.0"))
def knn_distance_page(spark, sf):
    return nearest(spark, sf, distance=(">", 1.0))


@query(f"""SELECT id, label, round(d, 6) + 0.0 AS distance, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY d, id) AS INT) AS rank FROM (SELECT vec_id AS id, label, {l2('embedding', 'q')} AS d FROM {E})) WHERE rank <= 3""")
def knn_per_group(spark, sf):
    rows = knn(vectors(spark, sf), query_vector(spark, sf), 3, per="label")
    return rows.select("id", "label", F.round("distance", 6).alias("distance"), "rank")


@query(near_sql(l2("e.embedding", "q")))
def static_vectors_knn(spark, sf):
    static_vectors(vectors(spark, sf), "static_vectors")
    return shown(knn(spark.table("static_vectors"), query_vector(spark, sf), K))


@query(f"""SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank FROM (
        SELECT CAST(l AS BIGINT) AS query_id, vec_id AS id, {l2('q', 'embedding')} AS d FROM embeddings, (SELECT label AS l, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label))) WHERE rank <= 10""")
def knn_batch(spark, sf):
    """The neighbours of the first vector of each label."""
    firsts = vectors(spark, sf).groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding"))
    return knn_join(firsts, vectors(spark, sf), K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def scalar(name: str, sql: str, column):
    """A query of one function of every vector v and the query vector q."""
    def run(spark, sf):
        v = F.col("embedding")
        q = literal(query_vector(spark, sf), "array<float>")
        return vectors(spark, sf).select("id", column(v, q).alias("value"))

    run.__name__ = name
    query(f"SELECT vec_id AS id, {sql} AS value FROM {E}")(run)


V = "e.embedding"
scalar("vec_distance_l2", rounded(l2(V, "q")), lambda v, q: F.round(vec.distance_l2(v, q), 6))
scalar("vec_distance_l1", rounded(l1(V, "q")), lambda v, q: F.round(vec.distance_l1(v, q), 6))
scalar("vec_distance_cosine", rounded(cosine(V, "q")), lambda v, q: F.round(vec.distance_cosine(v, q), 6))
scalar("vec_distance_hamming", "CAST(len(list_filter(list_zip(e.embedding, q), lambda z: (z[1] > 0) <> (z[2] > 0))) AS BIGINT)",
       lambda v, q: vec.distance_hamming(vec.quantize_binary(v), vec.quantize_binary(q)))
scalar("vec_dot", rounded(dot(V, "q")), lambda v, q: F.round(vec.dot(v, q), 6))
scalar("vec_norm", rounded(f"sqrt({dot(V, V)})"), lambda v, q: F.round(vec.norm(v), 6))
scalar("vec_add", as_json(zipped(V, "q", "CAST(z[1] + z[2] AS FLOAT)")), lambda v, q: vec.to_json(vec.add(v, q)))
scalar("vec_sub", as_json(zipped(V, "q", "CAST(z[1] - z[2] AS FLOAT)")), lambda v, q: vec.to_json(vec.sub(v, q)))
scalar("vec_slice", as_json("e.embedding[9:16]"), lambda v, q: vec.to_json(vec.slice(v, 8, 16)))
scalar("vec_normalize", as_json(f"list_transform(e.embedding::DOUBLE[], lambda x: CAST(x / sqrt({dot(V, V)}) AS FLOAT))"), lambda v, q: vec.to_json(vec.normalize(v)))
scalar("vec_quantize_int8", as_json(INT8.format(V)), lambda v, q: vec.to_json(vec.quantize_int8(v)))
scalar("vec_quantize_binary", "'[' || array_to_string(list_transform(e.embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), ',') || ']'",
       lambda v, q: vec.bits_to_json(vec.quantize_binary(v), 64))
scalar("vec_to_json", as_json(V), lambda v, q: vec.to_json(v))
scalar("vec_length", "len(e.embedding)::INT", lambda v, q: vec.length(v))
scalar("vec_f32", as_json(V), lambda v, q: vec.to_json(vec.f32(vec.to_json(v))))
scalar("vec_int8", as_json("list_transform(e.embedding::DOUBLE[], lambda x: CAST(trunc(x * 100) AS INT))"), lambda v, q: vec.to_json(vec.int8(F.transform(vec.doubles(v), lambda x: (x * 100).cast("int")))))


@query("SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding[9:48], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), ',') || ']' AS value, 64 AS bits FROM embeddings")
def vec_slice_bits(spark, sf):
    """Bits 8 up to 48 of the quantised vectors, and their length."""
    rows = vectors(spark, sf).select("id", vec.quantize_binary(F.col("embedding")).alias("b"))
    return rows.select("id", vec.bits_to_json(vec.slice_bits(F.col("b"), 8, 48), 40).alias("value"), vec.length(F.col("b"), "words").alias("bits"))


@query("SELECT vec_id AS id, 'float32' AS value FROM embeddings")
def vec_type(spark, sf):
    df = vectors(spark, sf)
    return df.select("id", vec.type(df, "embedding").alias("value"))


@query("SELECT doc_id AS id, CAST(list_sum(list_transform(string_split(sha256(text), ''), lambda c: bit_count(CAST('0x' || c AS INT)))) AS BIGINT) AS ones, 256 AS bits FROM documents")
def vec_bit(spark, sf):
    """The digests of all texts as bit vectors."""
    blob = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), blob.alias("blob"))
    ones = F.aggregate(vec.bit(F.col("blob")), F.lit(0), lambda s, w: s + F.bit_count(w)).cast("long")
    return rows.select("id", ones.alias("ones"), vec.length(F.col("blob"), "bit").alias("bits"))


@query("SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INT) AS rowid, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def vec_each(spark, sf):
    return vec.each(vectors(spark, sf).select("id", "embedding"), "embedding").select("id", "rowid", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"SELECT '{vec.VERSION}' AS version")
def engine_version(spark, sf):
    vec.register(spark)
    return spark.sql("SELECT vec_version() AS version")


@query(f"SELECT vec_id AS id, label, {as_json('embedding')} AS vector FROM embeddings")
def vec_scan(spark, sf):
    return vectors(spark, sf).select("id", "label", vec.to_json(F.col("embedding")).alias("vector"))


@query(f"SELECT vec_id AS id, label, {as_json('embedding')} AS vector FROM embeddings WHERE vec_id = 7")
def vec_point_lookup(spark, sf):
    return vec_scan(spark, sf).where("id = 7")


@query(f"SELECT vec_id AS id, label, {as_json('embedding')} AS vector FROM embeddings UNION ALL SELECT vec_id + 1000000000, label + 100, {as_json('embedding')} FROM embeddings")
def vec_insert(spark, sf):
    rows = vectors(spark, sf)
    more = rows.select((F.col("id") + 1_000_000_000).alias("id"), "embedding", (F.col("label") + 100).alias("label"))
    return appended(rows, more, SPEC).select("id", "label", vec.to_json(F.col("embedding")).alias("vector"))


@query(f"SELECT vec_id AS id, label, CASE WHEN label = 1 THEN {as_json(zipped('embedding', 'embedding', 'CAST(-z[1] AS FLOAT)'))} ELSE {as_json('embedding')} END AS vector FROM embeddings")
def vec_update(spark, sf):
    rows = vectors(spark, sf)
    turned = rows.where("label = 1").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return store.updated(rows, turned, fixed=("label",)).select("id", "label", vec.to_json(F.col("embedding")).alias("vector"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 2")
def vec_delete(spark, sf):
    rows = vectors(spark, sf)
    return store.deleted(rows, rows.where("label = 2").select("id")).select("id", "label")


@query("SELECT label, max(vec_id) AS latest_id FROM embeddings GROUP BY label")
def latest_per_partition(spark, sf):
    return store.latest_per_partition(vectors(spark, sf), ["label"])
