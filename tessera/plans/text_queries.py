"""Queries of text functions, transcripts and the service's formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.base import chunk_sql, query, table


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def chunk_rows(spark, sf, size, overlap):
    out = text.chunked(docs(spark, sf), "text", size, overlap)
    return out.select("id", "chunk_index", "start", "end", text.content_hash(F.col("content")).alias("content_hash"))


@query(f"SELECT id, chunk_index, start, stop AS end, content_hash FROM ({chunk_sql('SELECT doc_id AS id, text FROM documents', text.MAX_CHUNK, text.OVERLAP)})")
def chunk_documents(spark, sf):
    return chunk_rows(spark, sf, text.MAX_CHUNK, text.OVERLAP)


@query(f"SELECT id, chunk_index, start, stop AS end, content_hash FROM ({chunk_sql('SELECT doc_id AS id, text FROM documents', 300, 40)})")
def chunk_documents_utf8(spark, sf):
    """Small chunks, so that many cuts fall inside characters."""
    return chunk_rows(spark, sf, 300, 40)


@query("SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("id", text.content_hash(F.col("text")).alias("content_hash"))


@query(r"""SELECT doc_id AS id, len(k) AS n, sha256(array_to_string(k, ' ')) AS words_sha256
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ ,.?!;:\t\n]+'), lambda w: strlen(w) > 3) AS k FROM documents)""")
def query_keywords(spark, sf):
    k = text.keywords(F.col("text"))
    return docs(spark, sf).select("id", F.size(k).cast("long").alias("n"), F.sha2(F.array_join(k, " ").cast("binary"), 256).alias("words_sha256"))


@query(r"""SELECT doc_id AS id, len(k) AS n, sha256(array_to_string(k, chr(10))) AS lines_sha256 FROM (SELECT doc_id,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: l <> '') AS k FROM documents)""")
def trim_lines(spark, sf):
    k = F.filter(F.transform(F.split("text", "\n"), text.trimmed), lambda x: x != "")
    return docs(spark, sf).select("id", F.size(k).cast("long").alias("n"), F.sha2(F.array_join(k, "\n").cast("binary"), 256).alias("lines_sha256"))


LINE = "role || ': ' || replace(text, chr(10), ' ')"


@query(f"""WITH l AS (SELECT conv_id, turn, trim({LINE}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM conversations),
    n AS (SELECT line, row_number() OVER (ORDER BY conv_id, turn, line) - 1 AS pos FROM l WHERE line <> '')
    SELECT CAST(pos // 10 AS BIGINT) AS batch, string_agg(line || chr(10), '' ORDER BY pos) AS content, CAST(count(*) AS INT) AS lines FROM n GROUP BY 1""")
def conversation_batches(spark, sf):
    """All conversations as one export, ten lines to a batch."""
    rows = table(spark, sf, "conversations").withColumn("raw", F.concat("role", F.lit(": "), F.translate("text", "\n", " ")))
    return text.batch_lines(rows.withColumn("raw", text.trimmed("raw")).select("conv_id", "turn", F.col("raw").alias("line")), ["conv_id", "turn", "line"], "line")


TURN = "CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END || text || chr(10) || chr(10)"


@query(f"""WITH t AS (SELECT conv_id, string_agg({TURN}, '' ORDER BY turn, text) AS s FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1)
    SELECT * FROM (SELECT conv_id, CASE WHEN strlen(s) <= 6000 THEN s ELSE right(s, list_max(list_filter(range(6001), lambda n: strlen(right(s, n)) <= 6000))) END AS content FROM t) WHERE strlen(content) >= 40""")
def transcript_tail(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("said"), text.role(F.lit(None).cast("string"), F.col("role")).alias("role"))
    return text.transcript_tail(rows.withColumn("body", F.col("said")), ["conv_id"], ["turn", "said"], "role", "body")


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' ' END AS said FROM conversations")
def transcript_text(spark, sf):
    """Turns as a transcript's JSON, strings and blocks in turn, and their texts read back."""
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    arrays = F.to_json(F.array(block("text", F.col("text")), block("image", F.lit("x"))))
    plain = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    rows = table(spark, sf, "conversations").withColumn("content", F.when(F.col("turn") % 2 == 0, plain).otherwise(arrays))
    return rows.select("conv_id", "turn", "role", text.content_text(F.col("content")).alias("said"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS s FROM events")
def json_accessors(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_int(F.col("props"), "$.k").alias("k"), text.json_string(F.col("props"), "$.k").alias("s"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'SessionStart' WHEN 'signup' THEN 'SessionStart' WHEN 'purchase' THEN 'PreCompact' WHEN 'view' THEN 'Stop' ELSE 'unknown' END AS route FROM events")
def event_route(spark, sf):
    name = F.when(F.col("event_type") == "click", "SESSIONSTART").when(F.col("event_type") == "purchase", "PreCompact").when(F.col("event_type") == "view", "stop").otherwise("")
    old = F.when(F.col("event_type") == "signup", "session-start")
    return table(spark, sf, "events").select("event_id", text.event_route(name, old).alias("route"))


@query("""SELECT event_id, '{"jsonrpc":"2.0","id":' || event_id || ',"result":{"content":[{"type":"text","text":"' || event_type || '"}],"isError":false}}' AS line FROM events""")
def rpc_envelope(spark, sf):
    said = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text"))).alias("content"), F.lit(False).alias("isError"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), said.alias("result"))).alias("line"))


TOKEN = "CASE WHEN doc_id % 3 = 0 THEN n_chars || '.' || doc_id WHEN doc_id % 3 = 1 THEN lang || '-1' ELSE '2024-11-05' END"


@query(f"SELECT doc_id AS id, regexp_full_match({TOKEN}, '[0-9.-]{{1,32}}') AS safe FROM documents")
def safe_version(spark, sf):
    token = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(".", "n_chars", "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("-1"))).otherwise("2024-11-05")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.safe_version(token).alias("safe"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'directory' WHEN doc_id % 5 IN (1, 2) THEN 'conversation' ELSE 'file' END AS kind FROM documents")
def mine_dispatch(spark, sf):
    name = F.concat(F.lit("f"), "doc_id", F.array(*[F.lit(x) for x in ("", ".json", ".JSONL", ".md", "")])[(F.col("doc_id") % 5).cast("int")])
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.input_kind(name, F.col("doc_id") % 5 == 0).alias("kind"))
