"""Operator 1, licence scan: canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation, white space),
digested, and the digests of entire texts are joined with those of the known licences. All native columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_or_empty
from tessera.llm.license_texts import DIGESTS, KNOWN

#: Equivalent spellings (the second is canonical), and the steps of the canonical form in order.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("centre", "center"), ("colour", "color"), ("defence", "defense"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("modelling", "modeling"),
    ("noninfringment", "noninfringement"), ("organisation", "organization"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
STEPS = [
    (r"(^|\n)[ \t#/*;]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
    *((rf" {a} ", f" {b} ") for a, b in SPELLINGS),
]
#: More known licences than this are joined by a shuffle, fewer are broadcast (a digest and a name each).
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Lower case of A-Z, copyright lines dropped, runs of other ASCII characters than letters and digits made
    one space, spellings made equal. Two spaces stand between words, so each has its own on either side."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, STEPS[0][0], STEPS[0][1])
    out = F.concat(F.lit(" "), F.regexp_replace(out, STEPS[1][0], STEPS[1][1]), F.lit(" "))
    out = F.regexp_replace(out, " +", "  ")
    for a, b in STEPS[2:]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIGESTS.items()), "license_id string, canonical_sha256 string")


def license_scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digests: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, license_id (null: no known licence), canonical_sha256.

    known: (license_id, text); digests: more of them as (license_id, canonical_sha256). Null counts as empty, and an empty canonical text is no licence. If known texts share a digest, the first
    licence by name stands. Repeated rows are each returned; other columns are ignored, even clashing names.
    """
    digest = lambda c: F.sha2(canonical(text_or_empty(c)).cast("binary"), 256)
    table = known.where(F.length(F.trim(canonical(text_or_empty("text")))) > 0).select(digest("text").alias("canonical_sha256"), "license_id")
    if digests is not None:
        table = table.unionByName(digests.select("canonical_sha256", "license_id"))
    table = table.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = df.select(F.col(id_col), digest(text_col).alias("canonical_sha256"))
    return rows.join(table, "canonical_sha256", "left").select(id_col, "license_id", "canonical_sha256")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), known_licenses(spark), digests=known_digests(spark))


def op1_license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over all documents of which every twentieth is a known text in another spelling: upper case under a copyright
    line, other punctuation, or British spelling."""
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KNOWN)], "_k long, _known string")
    turn, text = F.col("doc_id") % 3, F.col("_known")
    variant = F.when(turn == 0, F.concat(F.lit("Copyright (c) 2020 Some One\n"), F.upper(text))).when(turn == 1, F.replace(text, F.lit(","), F.lit(" ;"))).otherwise(F.replace(text, F.lit("icense"), F.lit("icence")))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 20 == 0, F.floor(F.col("doc_id") / 20) % len(KNOWN)).alias("_k"))
    planted = docs.join(known, "_k", "left").select("doc_id", F.when(text.isNotNull(), variant).otherwise(F.col("text")).alias("text"))
    return license_scan(planted, known_licenses(spark), digests=known_digests(spark))


def _sql_canonical(col: str) -> str:
    q = lambda s: s.replace("'", "''")
    out = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{q(STEPS[0][0])}', chr(10), 'g')"
    out = f"regexp_replace(' ' || regexp_replace({out}, '{q(STEPS[1][0])}', ' ', 'g') || ' ', ' +', '  ', 'g')"
    for a, b in STEPS[2:]:
        out = f"replace({out}, '{q(a)}', '{q(b)}')"
    return out


VARIANTS = """(SELECT doc_id, CASE WHEN v.text IS NULL THEN d.text WHEN doc_id % 3 = 0 THEN 'Copyright (c) 2020 Some One' || chr(10) || upper(v.text)
    WHEN doc_id % 3 = 1 THEN replace(v.text, ',', ' ;') ELSE replace(v.text, 'icense', 'icence') END AS text
    FROM documents d LEFT JOIN texts v ON doc_id % 20 = 0 AND v.k = (doc_id // 20) % (SELECT count(*) FROM texts))"""


def op1_sql(source: str = "documents") -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in r)) for i, r in enumerate(KNOWN))
    digests = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS.items())
    return f"""
        WITH texts AS (SELECT * FROM (VALUES {rows}) AS v(k, license_id, text)),
        known AS (
            SELECT canonical_sha256, min(license_id) AS license_id FROM (
                SELECT sha256({_sql_canonical('text')}) AS canonical_sha256, license_id FROM texts
                UNION ALL SELECT canonical_sha256, license_id FROM (VALUES {digests}) AS v(license_id, canonical_sha256)) GROUP BY 1),
        docs AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS canonical_sha256 FROM {source})
        SELECT doc_id, license_id, canonical_sha256 FROM docs LEFT JOIN known USING (canonical_sha256)"""
