import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, license_scan, license_texts
from tests.llm.conftest import SF


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)


def test_exact_dedup_matches_brute_force(spark, docs):
    rows = [(i, ("copy of a text", "other\ttext", "", None, f"own {i}", "copy  of a text")[i % 6 if i % 7 else 0]) for i in range(400)]
    for lanes, fan_in in ((1, 2), (7, 2), (64, 4)):
        got = sorted(map(tuple, exact_dedup.exact_dedup(docs(rows), lanes=lanes, fan_in=fan_in).collect()))
        assert got == brute(rows)


def test_exact_dedup_edges(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == 11
    by = {(r.doc_id, r.kept): r for r in got}
    assert by[1, False].keep_id == 3 and by[1, False].group_size == 3  # the longest blank text stays
    assert by[4, False].keep_id == 5 and by[4, False].group_size == 5
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8, 9]


def test_one_of_repeated_rows_stays_and_null_ids_come_last(docs):
    rows = [(5, "x y z"), (5, "x y z"), (None, "same"), (2, "same"), (1, "same"), (7, "a b"), (7, "ab"), (None, "own"), (None, "o wn")]
    got = exact_dedup.exact_dedup(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (5, 5, 2, False), (5, 5, 2, True), (7, 7, 2, False), (7, 7, 2, True)]
    kept = exact_dedup.deduplicated(docs(rows)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == [(0, "o wn"), (1, "same"), (5, "x y z"), (7, "a b")]


def test_lanes_of_a_round_hold_no_digest_twice(spark, docs):
    rows = docs([(i, f"text {i % 50}") for i in range(2000)]).selectExpr("doc_id AS id", "text", "doc_id AS tag")
    entries = exact_dedup.digest_rows(rows, 16)
    leaf, winners = exact_dedup.tree_merge(entries, 16, 4)
    assert leaf.count() == leaf.select("lane", "text_sha256").distinct().count() > 50 and leaf.agg({"size": "sum"}).head()[0] == 2000
    assert winners.count() == 50 and winners.where("group_size = 40 AND keep_id < 50").count() == 50


@pytest.mark.parametrize("name", ["op1_license_scan", "op1_license_variants", "op2_exact_dedup"])
def test_queries_match_sql(spark, name):
    from tessera.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_license_scan_knows_variants(spark, docs, awkward, nothing):
    mit = license_texts.MIT
    rows = [
        (1, "MIT Licence\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit), (2, mit.upper().replace("\n", "   ")),
        (3, mit.replace("sublicense", "sublicence")), (4, mit + " and more"), (5, mit[:-20]), (6, "released under the mit licence"),
        (7, "licence licence licence"), (8, license_texts.BSD_3), (9, license_texts.ISC), (10, license_texts.ZERO_BSD)]
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs(rows), license_scan.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: "MIT", 7: None, 8: "BSD-3-Clause", 9: "ISC", 10: "0BSD"}
    out = license_scan.license_scan(awkward, license_scan.known_licenses(spark)).collect()
    assert len(out) == 11 and all(r.license_id is None for r in out)
    assert license_scan.license_scan(nothing, license_scan.known_licenses(spark)).count() == 0
    assert all(r.license_id is None for r in license_scan.license_scan(docs(rows), license_scan.known_licenses(spark).limit(0)).collect())


def test_digests_stand_for_whole_texts(spark, docs):
    rows = [(1, "Some long text, of A license"), (2, "SOME long text; of a licence!"), (3, "another"), (4, license_texts.MIT)]
    own = license_scan.license_scan(docs(rows[:1]), license_scan.known_licenses(spark)).select(F.lit("Own-1.0").alias("license_id"), "canonical_sha256")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(docs(rows), license_scan.known_licenses(spark), digests=own).collect()}
    assert got == {1: "Own-1.0", 2: "Own-1.0", 3: None, 4: "MIT"}
    assert all(len(d) == 64 for d in license_texts.DIGESTS.values()) and len(set(license_texts.DIGESTS.values())) == len(license_texts.DIGESTS)


def test_variants_are_found(spark):
    rows = license_scan.op1_license_variants(spark, SF).collect()
    assert all((r.license_id is not None) == (r.doc_id % 20 == 0) for r in rows if r.doc_id % 20 == 0) and sum(r.license_id is not None for r in rows) >= 10
