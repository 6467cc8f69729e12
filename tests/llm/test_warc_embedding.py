import base64
import hashlib
import io

import duckdb
import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed
from tessera.llm import warc
from tests.llm.conftest import SF

LARGE = "/root/testdata/sf0.1"


def test_warc_matches_sql(spark):
    df = warc.op8_warc(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({warc.OP8_SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_warc_revisits_and_edges(spark, monkeypatch):
    rows = [(1, "u", "same"), (5, "u\nv", "same"), (3, None, "same"), (2, "x", ""), (9, "x", None), (4, "é", "ünï\r\n\r\nWARC/1.1\r\n"), (-7, "neg", "own"), (6, "big", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.record_id: r for r in warc.warc_roundtrip(df, "page_id", "html", "url").collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: r.refers_to for i, r in got.items()} == {1: 5, 3: 5, 5: None, 2: 9, 9: None, 4: None, -7: None, 6: None}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {1, 3, 2}
    small = {r.record_id: r.record_type for r in warc.warc_roundtrip(df, "page_id", "html", min_bytes=5).collect()}
    assert set(small.values()) == {"response"}
    assert warc.warc_roundtrip(df.limit(0), "page_id", "html").count() == 0


def test_repeated_ids_null_ids_and_clashing_names(spark):
    rows = [(1, "u", "one", "x", 0), (1, "u", "two", "x", 0), (1, "u", "one", "x", 0), (2, "u", "two", "x", 0), (None, "u", "two", "x", 0), (3, "u", "own", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, n int")
    got = sorted(((r.record_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_roundtrip(df, "page_id", "html", "url").collect()), key=str)
    digest = {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in ("one", "two", "own")}
    want = [(1, digest["one"], "response", None)] * 2 + [(1, digest["two"], "revisit", 2), (2, digest["two"], "response", None), (3, digest["own"], "response", None), (None, digest["two"], "revisit", 2)]
    assert got == sorted(want, key=str)
    alone = df.where("page_id IS NULL").unionByName(df.where("page_id IS NULL"))
    assert [(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.warc_roundtrip(alone, "page_id", "html").collect()] == [(None, "response", None, 3)] * 2


def chunked(payload):
    parts = [payload[at : at + warc.CHUNK] for at in range(0, len(payload), warc.CHUNK)] or [b""]
    head = {"record_id": -3, "url": "u", "n": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "payload_digest": warc.base32(hashlib.sha1(payload).digest()), "record_type": "response", "refers_to": None}
    return [head | {"chunk_no": i, "chunk": c, "last": i == len(parts) - 1} for i, c in enumerate(parts)]


def test_chunks_carry_running_digests():
    out, payload = io.BytesIO(), b"ab" * (warc.CHUNK + 5)
    writer = warc.RecordWriter(out)
    for row in chunked(payload) + chunked(b""):
        writer.add(row)
    rows = list(warc.read_archive(warc._Buffered(io.BytesIO(out.getvalue()), 1000), "a"))
    assert [r["record_no"] for r in rows] == [0] * (len(rows) - 1) + [1] and all(r["record_id"] == -3 for r in rows)
    rows = rows[:-1]
    assert b"".join(r["chunk"] for r in rows) == payload and [r["chunk_no"] for r in rows] == list(range(len(rows)))
    assert max(len(r["chunk"]) for r in rows) <= warc.CHUNK and [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]
    so_far = b""
    for r in rows:
        so_far += r["chunk"]
        assert r["sofar_digest"] == warc.base32(hashlib.sha1(so_far).digest())
    cut = out.getvalue()[: out.getvalue().rindex(b"WARC/") - 500]
    with pytest.raises(ValueError, match="cut"):
        list(warc.read_archive(warc._Buffered(io.BytesIO(cut)), "a"))
    with pytest.raises(ValueError, match="make up"):
        warc.RecordWriter(io.BytesIO()).add(chunked(b"xy")[0] | {"chunk": b"xz"})


def test_chunk_table_of_a_large_payload(spark):
    n = 5 * warc.CHUNK + 7
    typed = spark.sql(f"SELECT 1L AS record_id, 'u' AS url, cast(repeat('abcdefg', {n // 7 + 1}) AS binary) AS payload").selectExpr(
        "record_id", "url", "payload", "cast(octet_length(payload) AS long) AS n", "sha2(payload, 256) AS sha256", "'' AS payload_digest", "'response' AS record_type", "cast(null AS long) AS refers_to")
    whole, rows = bytes(typed.head().payload), warc.chunk_rows(typed).collect()
    assert b"".join(bytes(r.chunk) for r in rows) == whole and [r.chunk_no for r in rows] == list(range(6)) and [r.last for r in rows] == [False] * 5 + [True]


def brute(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = x @ x.T >= threshold
    np.fill_diagonal(on, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(on, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return on, low
        low = new


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{LARGE}/embeddings.parquet").collect()
    on, low = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float), 0.95)
    got = {r.vec_id: r for r in ed.op9_embedding_dedup(spark, LARGE).collect()}
    links = sum(got[r.vec_id].n_links for r in rows)
    assert 0.95 * on.sum() <= links <= on.sum()
    assert np.mean([got[r.vec_id].component_id == c for r, c in zip(rows, low)]) > 0.97
    assert all(got[r.vec_id].n_links <= n for r, n in zip(rows, on.sum(axis=1)))


def test_clusters_blocks_and_copies(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centre] + [np.repeat(centre[:1], 30, axis=0)])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), "k") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, size string")
    on, low = brute(ids, x, 0.95)
    got = {r.vec_id: r for r in ed.embedding_dedup(df, block=7).collect()}
    assert all(got[i].component_id == c for i, c in zip(ids, low))
    assert sum(r.n_links for r in got.values()) >= 0.9 * on.sum() and all(got[i].n_links <= n for i, n in zip(ids, on.sum(axis=1)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_a_group_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(11)
    centre, x = rng.normal(size=64), rng.normal(size=(1500, 64))
    x[::3] = centre + 0.15 * x[::3]
    df = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "vec_id long, embedding array<double>")
    on, low = brute(range(len(x)), x, 0.95)
    assert on.sum() > 0.9 * 500 * 499
    got = {r.vec_id: r for r in ed.embedding_dedup(df, block=128).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.95 * on.sum() and all(r.n_links <= on[i].sum() for i, r in got.items())
    assert all(got[i].component_id == c for i, c in enumerate(low))


def test_every_dimension_links_and_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.05, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [3.0]), (7, [4.0]),
            (8, [0.0, 2.0]), (8, [0.0, 2.0]), (8, [-1.0, 0.01]), (None, [1.0, 0.0]), (None, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, "k", "t") for i, v in rows], "vec_id long, embedding array<double>, size int, code string, tag string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in ed.embedding_dedup(df).collect()))
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (0, 1, 3, False), (4, 2, 4, True), (8, 2, 4, False), (8, 2, 4, False), (5, 1, 5, True), (8, 1, 5, False),
                          (6, 1, 6, True), (7, 1, 6, False), (0, 0, 0, True)])


def test_counts_of_shared_pivots_match_brute_force():
    rng = np.random.default_rng(5)
    near = np.array([rng.permutation(12)[:5] for _ in range(60)], dtype="<i2")
    frame = ed.pd.DataFrame({"id": range(60), "size": 1, "near": [r.tobytes() for r in near], "vector": [r.tobytes() for r in rng.normal(size=(60, 3))]})
    for own in (0, 3, 7):
        part = frame[[own in r for r in near]]
        a = ed.List(part, 3)
        (lo, hi, tile), = a.tiles()
        got = ed.retrieved(tile, tile, hi, hi, own, 3)
        sets = [set(near[i]) for i in part["id"]]
        want = {(i, j) for i in range(hi) for j in range(hi) if len(sets[i] & sets[j]) >= 3 and min(sets[i] & sets[j]) == own}
        assert set(zip(*(x.tolist() for x in got))) == want


def test_a_million_equal_vectors_are_one_class(spark):
    df = spark.range(1_000_000, numPartitions=8).selectExpr("id AS vec_id", "array(float(1), float(2), float(3)) AS embedding").union(spark.sql("SELECT 2000000L, array(float(3), float(-2), float(1))"))
    got = ed.embedding_dedup(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2_000_000, True, 1), (999_999, 0, False, 999_999), (999_999, 0, True, 1)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-200, 0.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(df).collect()}
    assert got == {**{i: (0, i) for i in (1, 2, 3, 4, 5, 6, 10, 12)}, 7: (3, 7), 8: (3, 7), 9: (3, 7), 11: (3, 7)}
    assert ed.embedding_dedup(df.limit(0)).count() == 0
    assert ed.embedding_dedup(df.where("vec_id < 4")).count() == 3
