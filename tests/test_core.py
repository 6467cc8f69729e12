import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import text
from tessera.functions import vector as vec
from tessera.operators import digest, graph, search, store
from tessera.operators.knn import knn, knn_join
from tessera.operators.vector_table import VectorTable, VectorTableSpec
from tessera.palace import Palace
from tessera.plans.base import table
from tessera.plans.registry import ORACLE_SQL, QUERIES
from tessera.service import Service
from tessera.sources import config, mining, npy
from tessera.streaming.mine import mine_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), want.columns)


def brute_chunks(content, size, overlap):
    """Chunks by bytes, written out plainly."""
    raw, out, pos = content.encode(), [], 0
    back = lambda p: p if p >= len(raw) or raw[p] & 0xC0 != 0x80 else back(p - 1)
    while True:
        if len(raw) - pos <= size:
            return [*out, (pos, len(raw))]
        window = raw[pos : pos + size]
        end = back(pos + size)
        if b"\n\n" in window:
            if window.rindex(b"\n\n") > size // 4:
                end = pos + window.rindex(b"\n\n") + 2
        elif b"\n" in window and window.rindex(b"\n") > size // 4:
            end = pos + window.rindex(b"\n") + 1
        out.append((pos, end))
        pos = back(end - overlap)


@pytest.mark.parametrize(("name", "size", "overlap"), [("chunk_documents", 2048, 256), ("chunk_documents_utf8", 300, 40)])
def test_chunks_match_brute_force(spark, name, size, overlap):
    want = {(r.doc_id, i, s, e, hashlib.sha256(r.text.encode()[s:e]).hexdigest()) for r in table(spark, SF, "documents").collect() for i, (s, e) in enumerate(brute_chunks(r.text, size, overlap))}
    assert {tuple(r) for r in QUERIES[name](spark, SF).collect()} == want


def test_chunks_of_hard_texts(spark):
    texts = ["", "x" * 2048, "x" * 2049, "a\n\n" + "b" * 4000, "a" * 1500 + "\n\n" + "b" * 3000, "é" * 3000, "😀" * 2000, "l\n" * 3000, "a" * 700 + "\n" + "b" * 600 + "\n\n" + "c" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = text.chunked(df, "text").collect()
    for i, t in enumerate(texts):
        own = sorted((r.chunk_index, r.start, r.end) for r in got if r.id == i)
        assert [(s, e) for _, s, e in own] == brute_chunks(t, 2048, 256)
        assert all(e - s <= 2048 for _, s, e in own)
    assert text.chunked(spark.createDataFrame([(1, None)], "id int, text string"), "text").count() == 0


def test_mined_chunks_match_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    ends = [".md", ".py", ".png", "", ".PNG", ".lock", ".txt"]
    name = lambda i: f"{docs[i].source}/{'.f' if i % 13 == 0 else 'f'}{i}{ends[i % 7]}"
    chunks = lambda t: [(i, s, e, hashlib.sha256(t.encode()[s:e]).hexdigest()) for i, (s, e) in enumerate(brute_chunks(t, 2048, 256))]
    want = {("project", name(i), "file", *c) for i, r in docs.items() if i % 13 and i % 7 not in (2, 4, 5) for c in chunks(r.text)}
    got = QUERIES["mine_directory"](spark, SF).select("room", "source_path", "source_type", "chunk_index", "start", "end", "content_hash").collect()
    assert {(a, b.removeprefix("project/"), *rest) for a, b, *rest in map(tuple, got)} == want and len(got) == len(want)
    longest = min(docs.values(), key=lambda r: (-len(r.text.encode()), "project/" + name(r.doc_id)))
    got = QUERIES["mine_file"](spark, SF).select("chunk_index", "start", "end", F.sha2(F.col("content").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == chunks(longest.text)


def test_unreadable_files_are_errors(spark):
    files = spark.createDataFrame([("a/b.md", 3, bytearray(b"abc")), ("a/c.md", 5, None), ("a/d.png", 2, None)], "path string, length long, content binary")
    assert tuple(mining.stats(files).head()) == (1, 1, 3, 1)


def test_partition_filters_prune_and_bounds_repeat(spark):
    df = QUERIES["knn_partition_range"](spark, SF)
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(label" in plan and "<= 4)]" in plan
    rows = spark.createDataFrame([(i, [float(i)], i) for i in range(20)], "id long, embedding array<float>, n int")
    assert [r.id for r in knn(rows, [0.0], 3, where=[("n", ">=", 5), ("n", "<", 7)]).orderBy("id").collect()] == [5, 6]
    near = knn(rows, [4.2], 2, with_vector=True).orderBy("distance").collect()
    assert [(r.id, r.embedding) for r in near] == [(4, [4.0]), (5, [5.0])]


def test_bit_slices_by_bytes(spark):
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, 192)
    df = spark.createDataFrame([(bits.tolist(),)], "v array<int>").select(vec.quantize_binary(F.col("v").cast("array<float>")).alias("b"))
    for lo, hi in ((0, 8), (8, 72), (56, 192), (64, 128), (40, 136), (184, 192)):
        got = df.select(vec.bits_to_json(vec.slice_bits(F.col("b"), lo, hi), hi - lo).alias("j")).head().j
        assert json.loads(got) == bits[lo:hi].tolist(), (lo, hi)
    with pytest.raises(ValueError):
        vec.slice_bits(F.col("b"), 4, 8)
    with pytest.raises(Exception, match="beyond"):
        df.select(vec.slice_bits(F.col("b"), 8, 200)).collect()


def test_reranker_lowers_what_it_takes_for_relevant(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, embedding array<float>")
    drawers = spark.createDataFrame([(i, 1, f"text {i} " + "é" * 600, f"s{i}", 0) for i in range(6)], "id long, room_id long, content string, source_path string, created_at long")
    rooms, wings = spark.createDataFrame([(1, 1, "r")], "id long, wing_id long, name string"), spark.createDataFrame([(1, "w")], "id long, name string")
    seen = []

    def reranker(query, content):
        seen.append(content)
        if "text 1" in content:
            raise RuntimeError("down")
        return "text 2" in content

    run = lambda r: search.hybrid(vectors, drawers, rooms, wings, "zz", [0.0], limit=3, now=10**9, reranker=r).collect()
    plain, better = run(None), run(reranker)
    assert [r.id for r in plain] == [0, 1, 2] and [r.id for r in better] == [0, 1, 2]
    assert better[2].score == plain[2].score - 0.5 and better[1].score == plain[1].score and len(seen) == 6 and all(len(c.encode()) <= 500 for c in seen)


def test_identity_file_and_its_cap(tmp_path):
    assert digest.identity(str(tmp_path / "none")) == digest.NO_IDENTITY
    (tmp_path / "i.txt").write_text("I am é" + "x" * 20_000)
    assert digest.identity(str(tmp_path / "i.txt")) == ("I am é" + "x" * 20_000).encode()[: digest.IDENTITY_BYTES].decode()
    (tmp_path / "e.txt").write_text("")
    assert digest.identity(str(tmp_path / "e.txt")) == digest.NO_IDENTITY


def test_command_line_verbs(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "c.yaml").write_text(f"default_wing: home\ndatabase_path: {tmp_path}/db\n")
    (tmp_path / "note.md").write_text("rivers carry sand to the sea")
    said = lambda *argv: (main(["--config", str(tmp_path / "c.yaml"), *argv]), capsys.readouterr().out)[1]
    assert said("instructions").startswith("Search before") and said("init") == "" and "No results" in said("search", "rivers")
    assert "drawers_inserted=1" in said("mine", str(tmp_path / "note.md")) and "note.md\nrivers carry sand" in said("search", "rivers sand")
    assert "Drawers:         1" in said("stats") and "No knowledge graph" in said("kg") and "rivers carry" in said("wake-up", "--wing", "home")
    assert said("compare", "one text", "one text").strip() == "1.0000"
    monkeypatch.setattr("sys.stdin", io.StringIO('{"hook_event_name":"SessionStart"}'))
    assert "additionalContext" in said("hook")
    monkeypatch.setattr("sys.stdin", io.StringIO('{"id":1,"method":"tools/list"}\n'))
    assert len(json.loads(said("mcp"))["result"]["tools"]) == 4


def test_a_write_counts_for_all_tables_or_for_none(spark, tmp_path):
    palace = Palace.open(spark, str(tmp_path / "store"), dim=8)
    palace.store("first text", "w", now=1)

    class Broken:
        def column(self, content):
            return F.when(F.raise_error(F.lit("model is gone")).isNotNull(), F.array(F.lit(1.0).cast("float")))

    whole, palace.embedder = palace.embedder, Broken()
    with pytest.raises(Exception, match="model is gone"):
        palace.store("second text", "w", now=2)
    again = Palace.open(spark, str(tmp_path / "store"), dim=8)
    for p in (palace, again):
        assert p.table("drawers").count() == p.table("vec_drawers").count() == 1
    again.store("second text", "w", now=3)
    palace.embedder = whole
    assert palace.db.state.number < again.db.state.number and palace.db.rows("drawers") == 1  # another has written since
    assert palace.store("third text", "w", now=4) == 3 and palace.table("vec_drawers").count() == 3


def test_mined_files(spark):
    rows = QUERIES["mine_directory"](spark, SF).collect()
    want = {r.doc_id for r in table(spark, SF, "documents").collect() if r.doc_id % 13 and r.doc_id % 7 not in (2, 4, 5)}
    assert {int("".join(c for c in r.source_path.rpartition("/")[2].split(".")[0] if c.isdigit())) for r in rows} == want
    assert {r.room for r in rows} == {"project"} and QUERIES["mine_file"](spark, SF).count() >= 1


def test_two_vectors_384(spark):
    df = spark.createDataFrame([(1, [0.5] * 384), (2, [1.0] * 384)], "id int, embedding array<float>")
    a, b = knn(df, [0.5] * 384, 2).collect()
    assert (a.id, b.id) == (1, 2) and a.distance < 0.001 and abs(b.distance - 9.798) < 0.001
    assert knn(df, [0.5] * 384, 0).count() == 0
    for bad in ({"k": 4097}, {"k": -1}):
        with pytest.raises(ValueError):
            knn(df, [0.5] * 384, **bad)
    with pytest.raises(ValueError):
        knn(df, [1.0] * 384, 1, metric="hamming")
    with pytest.raises(Exception, match="dimensions"):
        knn(df, [1.0] * 3, 1).collect()


def test_vector_edges(spark):
    df = spark.createDataFrame([([0.0] * 8, [120, -120], bytearray(b"\x01\x80"))], "v array<float>, i array<tinyint>, b binary")
    r = df.select(
        vec.distance_cosine(F.col("v"), F.col("v")).alias("c"), vec.normalize(F.col("v")).alias("n"), vec.add(F.col("i"), F.col("i"), "int8").alias("a"), vec.sub(F.col("i"), F.array(F.lit(-100), F.lit(100)).cast("array<tinyint>"), "int8").alias("s"),
        vec.bits_to_json(vec.bit(F.col("b")), 16).alias("j"), vec.to_json(F.array(F.lit(float("nan")))).alias("nan"), vec.quantize_int8(F.array(F.lit(float("nan")), F.lit(9.0), F.lit(-9.0))).alias("q"),
        vec.f32(F.lit(" [1 2.5,-3e1,] x")).alias("f"), vec.f32_blob(F.lit(bytearray(np.array([1.5, -0.25, 3e-40], "<f4").tobytes()))).alias("fb")).head()
    assert np.isnan(r.c) and np.isnan(r.n).all() and list(r.a) == [-16, 16] and list(r.s) == [-36, 36]
    assert r.j == "[1,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1]" and r.nan == "[null]" and list(r.q) == [127, 127, -128] and r.f == [1.0, 2.5, -30.0]
    assert r.fb[:2] == [1.5, -0.25] and abs(r.fb[2] - 3e-40) < 1e-44
    assert [x.value for x in vec.each(df, "b", "bit").orderBy("rowid").collect()] == [0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    for bad in (lambda: vec.slice(F.col("v"), 3, 3), lambda: vec.quantize_int8(F.col("v"), "x")):
        with pytest.raises(ValueError):
            bad()


def test_knn_join_in_blocks(spark, monkeypatch):
    from tessera.operators import knn as module

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    monkeypatch.setattr(module, "QUERY_BYTES", 25 * 8 * 8)
    for metric in ("l2", "l1", "cosine"):
        got = knn_join(df.withColumnRenamed("id", "query_id"), df, 4, metric=metric).collect()
        far = {"l2": lambda a, b: np.linalg.norm(a - b), "l1": lambda a, b: np.abs(a - b).sum(), "cosine": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[metric]
        for i in range(60):
            want = sorted((round(far(x[i], x[j]), 9), j) for j in range(60))[:4]
            mine = [(round(r.distance, 9), r.id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
            assert np.allclose([d for d, _ in want], [d for d, _ in mine]) and len(mine) == 4
            if metric != "cosine":
                assert mine == want


def test_vector_table(spark, tmp_path):
    spec = VectorTableSpec({"v": ("float32", 2)}, partition={"p": "text"}, metadata={"m": "int"}, auxiliary={"x": "text"})
    t = VectorTable(spark, str(tmp_path / "t"), spec)
    rows = [(1, [0.0, 1.0], "a", 1, "q"), (2, [1.0, 0.0], "b", 2, None)]
    t.insert(spark.createDataFrame(rows, spec.schema()))
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame(rows[:1], spec.schema()))
    with pytest.raises(Exception, match="dimensions"):
        t.insert(spark.createDataFrame([(3, [1.0], "a", 1, "")], spec.schema()))
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([(1, "z")], "id long, p string"))
    t.update(spark.createDataFrame([(1, 9), (77, 1)], "id long, m long"))
    assert t.get(1).head().m == 9 and t.knn([1.0, 0.0], 1).head().id == 2
    with pytest.raises(ValueError):
        t.knn([1.0, 0.0], 1, where={"x": ("=", "q")})
    t.delete(spark.createDataFrame([(2,), (55,)], "id long"))
    assert [r.id for r in VectorTable(spark, str(tmp_path / "t"), spec).scan().collect()] == [1]
    for bad in ({"vectors": {}}, {"vectors": {"v": ("float32", 9000)}}, {"vectors": {"v": ("bit", 8)}, "metrics": {"v": "l2"}}, {"vectors": {"v": ("float32", 2)}, "metadata": {"m": "blob"}}):
        with pytest.raises(ValueError):
            VectorTableSpec(**bad)


def test_palace_end_to_end(spark, tmp_path):
    folder = tmp_path / "testwing"
    (folder / "sub").mkdir(parents=True)
    for name, content in {"biology.txt": "cells divide and copy their genes", "coffee.txt": "espresso needs fine ground coffee beans", "sub/algorithms.txt": "sorting numbers with a heap",
                          "history.txt": "the empire fell long ago", "skip.png": "x", ".hidden": "x", "empty.txt": ""}.items():
        (folder / name).write_text(content)
    palace = Palace.open(spark, str(tmp_path / "store"))
    assert "empty" in palace.wake_up() and palace.search("coffee", now=1).count() == 0
    done = palace.mine(str(folder), "testwing", now=1000)
    assert (done.files_processed, done.files_skipped, done.drawers_inserted) == (4, 1, 4)
    assert palace.mine(str(folder), "testwing", now=1001).drawers_inserted == 0
    assert palace.search("ground coffee", 3, now=1000).head().source_path == "coffee.txt"
    service = Service(palace, now=lambda: 2000)
    call = lambda name, **args: json.loads(service.handle_rpc(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})))["result"]["content"][0]["text"]
    said = json.loads(service.handle_rpc('{"jsonrpc":"2.0","id":7,"method":"initialize","params":{"protocolVersion":"2025-01-01"}}'))
    assert said["id"] == 7 and said["result"]["protocolVersion"] == "2025-01-01"
    assert "2024-11-05" in service.handle_rpc('{"id":1,"method":"initialize","params":{"protocolVersion":"1\\",\\"x\\":\\""}}')
    assert len(json.loads(service.handle_rpc('{"id":1,"method":"tools/list"}'))["result"]["tools"]) == 4
    assert service.handle_rpc("{bad") is None and service.handle_rpc('{"method":"notifications/initialized"}') is None and "-32601" in service.handle_rpc('{"id":1,"method":"no"}')
    first = call("memory_store", content="we chose parquet for storage")
    assert first == call("memory_store", content="we chose parquet for storage") and first.endswith("in default/notes.")
    assert "parquet" in call("memory_search", query="parquet storage", limit=9999999999) and call("memory_search", query="parquet", limit=-5).startswith("Found 1 relevant memory:")
    assert call("memory_search") == "Error: MissingQuery" and call("nothing") == "Unknown tool: nothing"
    assert json.loads(service.handle_rpc('{"id":1,"method":"tools/call","params":{"name":5}}'))["result"]["content"][0]["text"] == "Error: MissingToolName"
    assert "Drawers:         5" in call("memory_stats")
    assert "additionalContext" in service.process_hook({"hook_event_name": "SessionStart"})["hookSpecificOutput"]
    lines = [{"type": "user", "message": {"role": "user", "content": "please remember the zebra protocol and its many rules"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "noted, zebra"}]}}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert service.process_hook({"hook_event_name": "PreCompact", "transcript_path": str(tmp_path / "t.jsonl")}) == {}
    tail = palace.table("drawers").where("source_path = 'precompact-autosave'").head().content
    assert tail == "User: please remember the zebra protocol and its many rules\n\nAssistant: noted, zebra \n\n"
    assert service.process_hook({"hook": "precompact", "transcript_path": str(tmp_path / "none")}) == {} and service.process_hook({}) == {}
    palace.mine(str(tmp_path / "t.jsonl"), "chats", now=3000)
    assert [r.name for r in palace.rooms("chats").collect()] == ["chat"]
    palace.see_entities(spark.createDataFrame([("a", "x"), ("b", "x")], "name string, entity_type string"), 5)
    ids = {r.name: r.id for r in palace.table("entities").collect()}
    edge = spark.createDataFrame([(ids["a"], "knows", ids["b"])], "subject_id long, predicate string, object_id long")
    palace.add_edges(edge, 6)
    palace.add_edges(edge, 7)
    assert [(r.subject, r.object, r.valid_from) for r in palace.edges("a").collect()] == [("a", "b", 6)] and palace.edges_as_of(5).count() == 0
    palace.forget("testwing")
    assert palace.search("coffee", now=1).where("wing_name = 'testwing'").count() == 0
    more = tmp_path / "stream"
    more.mkdir()
    (more / "new.md").write_text("a streamed file about rivers")
    mine_stream(spark, str(more), palace, "streamed", str(tmp_path / "cp"), now=lambda: 4000).awaitTermination()
    assert palace.search("rivers streamed", 1, now=4000).head().wing_name == "streamed"


def test_npy(spark, tmp_path):
    spark.dataSource.register(npy.NpySource)
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "one.npy", x[0])
    np.save(tmp_path / "none.npy", np.zeros(0, "<f4"))
    read = lambda n: [(r.rowid, r.vector) for r in spark.read.format("npy").load(str(tmp_path / n)).collect()]
    assert sorted(read("a.npy")) == [(i, x[i].tolist()) for i in range(4)] and read("one.npy") == [(0, [0.0, 1.0, 2.0])] and read("none.npy") == []
    np.save(tmp_path / "f8.npy", x.astype("f8"))
    np.save(tmp_path / "order.npy", np.asfortranarray(x))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-1])
    for bad in ("f8.npy", "order.npy", "cut.npy"):
        with pytest.raises(Exception):
            read(bad)


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# x\ndefault_wing: 'mine'\nauto_accept_entities: true\nignore_patterns:\n  - \"*.log\"\n  - tmp\nother: 1\ndatabase_path: /a\n")
    got = config.load(str(tmp_path / "none"), str(tmp_path / "c.yaml"), environ={"TESSERA_PATH": "/b"})
    assert (got.default_wing, got.auto_accept_entities, got.ignore_patterns, got.database_path) == ("mine", True, ["*.log", "tmp"], "/b")


def test_writes(spark):
    rows = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, None)], "id long, content_hash string")
    assert sorted(r.id for r in store.first_of_hash(rows).collect()) == [1, 3]
    assert sorted(map(tuple, store.resolved(rows, rows.where("id > 2")).collect())) == [(1, 1, True), (2, 1, False), (3, 3, False)]
    assert [r.id for r in store.dedup(rows, rows.where("id = 3")).collect()] == [1]
    old = spark.createDataFrame([(1, 1, "p", 2, 1.0, 5, 9, None, 5)], "id long, subject_id long, predicate string, object_id long, confidence double, valid_from long, valid_until long, source_drawer_id long, created_at long")
    edge = spark.createDataFrame([(1, "p", 2)], "subject_id long, predicate string, object_id long")
    once = graph.add_edges(old, edge, 20)
    assert once.count() == 2 and graph.add_edges(once, edge, 30).count() == 2


def test_text_edges(spark):
    df = spark.createDataFrame([('{"a":"","b":2.0,"c":"12","d":true,"e":[1]}', "aé" * 200)], "j string, t string")
    r = df.select(*[text.json_int(F.col("j"), f"$.{k}").alias(k) for k in "bcde"], text.json_string(F.col("j"), "$.a").alias("a"), text.json_string(F.col("j"), "$.c").alias("s"),
                  text.prefix_bytes(F.col("t"), 200).alias("p"), text.suffix_bytes(F.col("t"), 200).alias("q"), text.safe_version(F.lit("1.2\n")).alias("v")).head()
    assert (r.b, r.c, r.e, r.a, r.s, r.v) == (2, 12, None, None, "12", False)
    raw = ("aé" * 200).encode()
    assert r.p == raw[:200].decode("utf-8", "ignore") and r.q == raw[-200:].decode("utf-8", "ignore")


def test_json_rounds_ties_to_even_as_the_sql_does(spark, duck):
    """k/128 lies between two numbers of six decimals."""
    numbers = [k / 128 for k in range(-300, 301)] + [1234.0078125, -4096.5078125, 5e-7, -1e-7, -0.0, 0.0, 12345678.0, 2.0**53, float("inf")]
    df = spark.createDataFrame([(numbers,)], "v array<double>")
    got = df.select(vec.to_json(F.col("v")).alias("j")).head().j
    assert got == "[" + ",".join("Infinity" if x == float("inf") else f"{x:.6f}" for x in numbers) + "]"
    want = [r[0] for r in duck.execute("SELECT printf('%.6f', x) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers[:-1]]).fetchall()]
    assert got[1:-1].split(",")[:-1] == want
    vec.register(spark)
    df.createOrReplaceTempView("ties")
    assert spark.sql("SELECT vec_to_json(v) FROM ties").head()[0] == got
    assert df.select(vec.to_json(F.array(F.lit(9 / 128), F.lit(None).cast("double"))).alias("j")).head().j == "[0.070312,null]"


@pytest.mark.parametrize("name", [
    "sql_vec_f32", "sql_vec_normalize", "sql_vec_sub", "sql_vec_to_json", "vec_add", "vec_f32", "vec_insert", "vec_normalize", "vec_scan", "vec_sub", "vec_to_json",
])
def test_a_table_of_ties_gives_the_rows_of_the_sql(spark, tmp_path, name):
    """Odd multiples of 1/128, of which row 1 has length 1; row 0, the query vector, has even ones, so sums and differences are odd."""
    import duckdb

    sign = [1 - k // 3 % 2 * 2 for k in range(64)]
    vectors = [[0.125] * 64, [s * (15 if k < 33 else 17) / 128 for k, s in enumerate(sign)], [(2 * k - 63) / 128 for k in range(64)],
               [s * (2.0 ** (k % 16) + 1 / 128) for k, s in enumerate(sign)]]
    place = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(zip(range(4), vectors, range(4))), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(place)
    got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{place}/*.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_json_gives_large_floats_all_their_digits_as_the_sql_does(spark, duck):
    floats = np.random.default_rng(3).integers(2**23, 2**24, 600).astype(float) * 2.0 ** np.arange(30, 105).repeat(8)
    numbers = [s * float(x) for x in [*floats, *(2.0**k for k in range(40, 128)), 2.0**53 - 2**29, 1e10, 2.0**128 - 2.0**104] for s in (1, -1)]
    assert all(x == float(np.float32(x)) for x in numbers)
    df = spark.createDataFrame([(numbers,)], "v array<float>")
    vec.register(spark)
    df.createOrReplaceTempView("large")
    want = [r[0] for r in duck.execute("SELECT printf('%.6f', x) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()]
    assert want == [f"{x:.6f}" for x in numbers]
    for got in (df.select(vec.to_json(F.col("v"))).head()[0], spark.sql("SELECT vec_to_json(v) FROM large").head()[0]):
        assert got[1:-1].split(",") == want


def test_a_worker_gives_places_of_chunks_only(spark):
    """Of a batch whose chunks overlap and hold several times its objects, Python makes two numbers a chunk."""
    rows = [(1, None), (2, ""), (3, "é" * 5000), (4, "a\n\nb" * 900), (5, "日本" * 40_000), (6, None)]
    out = text.chunked(spark.createDataFrame(rows, "id int, t string").coalesce(1), "t", 300, 40)
    assert "places(" in out._jdf.queryExecution().analyzed().toString()
    own = {}
    for r in out.collect():
        own.setdefault(r.id, []).append(r)
    assert sorted(own) == [2, 3, 4, 5]
    for i, t in rows:
        if t is not None:
            raw = t.encode()
            assert [(r.start, r.end) for r in own[i]] == brute_chunks(t, 300, 40) and [r.chunk_index for r in own[i]] == list(range(len(own[i])))
            assert all(r.content == raw[r.start : r.end].decode() for r in own[i])
