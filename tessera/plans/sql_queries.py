"""The vector functions by their SQL names: each query is the SQL text of one, over a view of `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vector as vec
from tessera.operators.shared import new_path
from tessera.plans import vector_queries  # noqa: F401  its queries' SQL is that of these
from tessera.plans.base import ORACLE_SQL, query, stamp, vectors
from tessera.sources import npy

BITS = "vec_quantize_binary({})"
#: The query of the same name without "sql_" has the oracle's SQL.
BY_SQL = {
    "vec_distance_l2": "round(vec_distance_l2(v, q), 6)", "vec_distance_l1": "round(vec_distance_l1(v, q), 6)", "vec_distance_cosine": "round(vec_distance_cosine(v, q), 6)",
    "vec_distance_hamming": f"vec_distance_hamming({BITS.format('v')}, {BITS.format('q')})", "vec_dot": "round(vec_dot(v, q), 6)", "vec_norm": "round(vec_norm(v), 6)",
    "vec_add": "vec_to_json(vec_add(v, q))", "vec_sub": "vec_to_json(vec_sub(v, q))", "vec_slice": "vec_to_json(vec_slice(v, 8, 16))", "vec_normalize": "vec_to_json(vec_normalize(v))",
    "vec_quantize_int8": "vec_to_json(vec_quantize_int8(v, 'unit'))", "vec_to_json": "vec_to_json(v)", "vec_length": "vec_length(v)", "vec_f32": "vec_to_json(vec_f32(vec_to_json(v)))",
    "vec_int8": "vec_to_json(vec_int8(to_json(transform(v, x -> int(x * 100D)))))", "vec_type": "vec_type(typeof(v))",
    "vec_quantize_binary": "concat('[', array_join(transform(sequence(0, 63), i -> shiftright(vec_quantize_binary(v)[0], i) & 1L), ','), ']')",
}


def view(spark, sf) -> str:
    """A view of the vectors, named after their table's state."""
    vec.register(spark)
    name = f"vectors_{abs(hash((sf, stamp(spark, f'{sf}/embeddings.parquet'))))}"
    vectors(spark, sf).select("id", F.col("embedding").alias("v")).createOrReplaceTempView(name)
    return name


def by_sql(name: str, expression: str) -> None:
    def run(spark, sf):
        of = view(spark, sf)
        return spark.sql(f"SELECT id, {expression} AS value FROM {of} CROSS JOIN (SELECT v AS q FROM {of} WHERE id = 0)")

    run.__name__ = f"sql_{name}"
    query(ORACLE_SQL[name])(run)


for _name, _expression in BY_SQL.items():
    by_sql(_name, _expression)


@query(ORACLE_SQL["vec_each"])
def sql_vec_each(spark, sf):
    """The table function, beside each row."""
    return spark.sql(f"SELECT id, rowid, round(value, 6) AS value FROM {view(spark, sf)}, LATERAL vec_each(v)")


@query(ORACLE_SQL["vec_bit"])
def sql_vec_bit(spark, sf):
    """The digests of all texts as bit vectors."""
    vec.register(spark)
    return spark.sql(f"""
        SELECT id, cast(aggregate(vec_bit(blob), 0, (s, w) -> s + bit_count(w)) AS BIGINT) AS ones, vec_length_bit(blob) AS bits
        FROM (SELECT doc_id AS id, unhex(sha2(cast(text AS BINARY), 256)) AS blob FROM parquet.`{sf}/documents.parquet`)""")


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, len(embedding)::INT AS dimensions FROM embeddings")
def sql_npy_each(spark, sf):
    """The vectors as .npy files, one for each batch that a task holds, all read by one SQL query."""
    vec.register(spark)
    place = new_path(spark, "npy")
    vectors(spark, sf).select("id", "embedding").mapInPandas(npy.writer(place), npy.WRITTEN).write.parquet(f"{place}-paths")
    return spark.sql(f"SELECT ids[rowid] AS id, round(cast(vector[0] AS DOUBLE), 6) AS first, size(vector) AS dimensions FROM parquet.`{place}-paths`, LATERAL npy_each(path)")
