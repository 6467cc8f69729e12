"""Versions of tables: several writers, deletions, compaction, counts, lookups; typed inserts; SQL functions; merging stores."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import vector as vec
from tessera.operators.vector_table import VectorTable, VectorTableSpec
from tessera.operators.versions import Change, Conflict, Files, Store
from tessera.palace import Palace

KIND = "id long, v string"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def rows(spark, *ids, v="x"):
    return spark.createDataFrame([(i, v) for i in ids], KIND)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    path, errors = str(tmp_path / "s"), []

    def write(k):
        try:
            mine = Store(spark, path, {"t": KIND, "u": KIND})
            for n in range(6):
                first = mine.reserve("t", 2)
                mine.append("t", rows(spark, first, first + 1))
                mine.replace("u", lambda old, k=k, n=n: old.unionByName(rows(spark, 100 * k + n)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    s = Store(spark, path, {"t": KIND, "u": KIND})
    assert not errors and ids(s.table("t")) == list(range(1, 25)) and s.rows("t") == 24
    assert ids(s.table("u")) == [100 * k + n for k in (1, 2) for n in range(6)]
    assert s.state.number == 36 and any(n.endswith(".state.json") for n in s.files.names())


def test_what_no_commit_names_is_not_there(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"t": KIND})
    s.append("t", rows(spark, 1))
    s.stage("t", rows(spark, 2))  # a writer that is killed before its commit
    s.deletion(s.placed("t"))
    again = Store(spark, str(tmp_path / "s"), {"t": KIND})
    assert ids(again.table("t")) == [1] and again.rows("t") == 1
    assert again.vacuum(older_than=3600) == [] and len(again.vacuum(older_than=-60)) == 2 and ids(again.table("t")) == [1]


def test_commits_after_what_others_did(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"t": KIND, "u": KIND})
    s.append("t", rows(spark, *range(10)))
    base = s.state
    other = Store(spark, str(tmp_path / "s"), {"t": KIND, "u": KIND})
    other.append("u", rows(spark, 1))
    part = s.stage("t", rows(spark, 50))
    assert s.commit(Change(add={"t": [part]}, built_on=["t"]), base).number == 3  # the other wrote another table
    with pytest.raises(Conflict):
        s.commit(Change(add={"t": [part]}, built_on=["t"]), base)
    deleted = other.delete("t", rows(spark, 3, 4, 99))
    with pytest.raises(Conflict):  # a deletion counts rows of a part that has changed
        s.commit(Change(delete={"t": s.deletion(s.placed("t", base))}), base)
    assert deleted == 2 and other.rows("t") == 9 and ids(other.table("t")) == [0, 1, 2, 5, 6, 7, 8, 9, 50]
    assert ids(other.table("t", base)) == list(range(10))  # an earlier state can still be read


def test_names_are_taken_once(spark, tmp_path):
    files = Files(spark, str(tmp_path / "log"))
    for local in (True, False):
        files.local = local
        assert files.put_new(f"a{local}", "one é") and not files.put_new(f"a{local}", "two") and files.read(f"a{local}") == "one é"
    assert files.names() == ["aFalse", "aTrue"] or all(n.startswith((".", "a")) for n in files.names())


def test_deletions_are_small_and_folded_in(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store(spark, path, {"t": "id long, v string, w string"})
    many = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"), F.sha2(F.concat("id", F.lit("w")), 512).alias("w")).coalesce(1)
    s.append("t", many)
    whole = size(f"{path}/t")
    assert s.delete("t", spark.range(0, 20_000, 100)) == 200 and s.delete("t", spark.range(0, 20_000, 100)) == 0
    assert size(f"{path}/_deletions") < 0.05 * whole and size(f"{path}/t") == whole
    left = [i for i in range(20_000) if i % 100]
    assert ids(s.table("t")) == left and s.rows("t") == len(left)
    s.append("t", many.where("id = 300"))  # a deleted id comes again
    assert s.table("t").where("id = 300").count() == 1 and s.rows("t") == len(left) + 1
    before = {tuple(r) for r in s.table("t").collect()}
    assert s.compact("t", share=0.5) == 0 and s.compact("t", share=0.001) == 1
    assert {tuple(r) for r in s.table("t").collect()} == before and s.compact("t", share=0.001) == 0
    assert s.compact("t", small=10**6) == 2 and len(s.state.parts["t"]) == 1 and {tuple(r) for r in s.table("t").collect()} == before


SPEC = VectorTableSpec({"v": ("float32", 2)}, partition={"p": "text"}, metadata={"m": "int", "f": "float"}, auxiliary={"x": "text"})


def test_inserts_are_typed_and_unique(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"), SPEC)
    kind = "id long, v array<float>, p string, m long, f double, x string"
    good = spark.createDataFrame([(1, [0.0, 1.0], "a", 1, 1.0, None), (2, [1.0, 0.0], "b", 2, 2.0, "q")], kind)
    for bad in (good.withColumn("m", F.lit("one")), good.withColumn("m", F.lit(1.5)), good.withColumn("p", F.lit(1)), good.withColumn("x", F.lit(True)), good.withColumn("id", F.lit("a")), good.drop("f"),
                good.withColumn("v", F.col("v").cast("array<double>")), good.unionByName(good.where("id = 1"))):
        with pytest.raises(ValueError):
            t.insert(bad)
    for bad in (good.withColumn("id", F.expr("nullif(id, 1)")), good.withColumn("m", F.expr("nullif(m, 1)")), good.withColumn("v", F.array(F.lit(1.0).cast("float")))):
        with pytest.raises(Exception, match="null|dimensions"):
            t.insert(bad)
    assert t.scan().count() == t.count() == 0
    t.insert(good.withColumn("m", F.col("m").cast("int")).withColumn("f", F.col("f").cast("float")))
    with pytest.raises(ValueError):
        t.insert(good.where("id = 2"))
    assert t.scan().schema == SPEC.schema() or t.scan().dtypes == spark.createDataFrame([], SPEC.schema()).dtypes
    t.update(spark.createDataFrame([(2, 9)], "id long, m long"))
    assert t.count() == 2 and t.get(2).head().m == 9 and t.get(2).head().p == "b"
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([(77, "z")], "id long, p string"))
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert t.compact() == 1 and [r.id for r in t.knn([0.0, 1.0], 5).collect()] == [2] and t.count() == 1


def test_two_inserts_of_one_id(spark, tmp_path):
    kind = "id long, v array<float>, p string, m long, f double, x string"
    outcome = []
    VectorTable(spark, str(tmp_path / "t"), SPEC)

    def write(k):
        t = VectorTable(spark, str(tmp_path / "t"), SPEC)
        try:
            t.insert(spark.createDataFrame([(5, [0.0, 1.0], "a", k, 1.0, None), (10 + k, [0.0, 1.0], "a", k, 1.0, None)], kind))
            outcome.append("in")
        except ValueError:
            outcome.append("refused")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = VectorTable(spark, str(tmp_path / "t"), SPEC)
    assert sorted(outcome) == ["in", "refused", "refused"] and t.scan().where("id = 5").count() == 1 and t.count() == 2


@pytest.mark.parametrize("kind", ["int", "text"])
def test_a_lookup_reads_few_rows(spark, tmp_path, kind):
    spec = VectorTableSpec({"v": ("float32", 8)}, id_type=kind)
    t = VectorTable(spark, str(tmp_path / kind), spec, write={"parquet.block.size": "65536", "parquet.page.size": "8192", "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"})
    name = F.col("id") if kind == "int" else F.sha2(F.col("id").cast("string"), 256)
    t.insert(spark.range(30_000).withColumn("v", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("id") * i).cast("float"))).withColumn("id", name))
    key = t.scan().orderBy(F.rand(1)).head().id
    hit = t.get(key)
    assert [r.id for r in hit.collect()] == [key]
    plan = hit._jdf.queryExecution().executedPlan()
    scan = [m for m in plans(plan) if m.nodeName().startswith("Scan parquet")]
    assert sum(s.metrics().apply("numOutputRows").value() for s in scan) < 0.05 * 30_000
    assert t.get(-1 if kind == "int" else "nowhere").count() == 0


def plans(node):
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        yield from plans(node.executedPlan())
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from plans(children.apply(i))


@pytest.fixture(scope="module")
def sql(spark):
    vec.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS x").head().x


def test_sql_functions_do_what_the_columns_do(spark, sql):
    one = spark.range(1)
    both = {
        "vec_distance_l2(array(1D, 2D), array(4D, 6D))": vec.distance_l2(F.expr("array(1D, 2D)"), F.expr("array(4D, 6D)")),
        "vec_distance_l1(array(1D, 2D), NULL)": vec.distance_l1(F.expr("array(1D, 2D)"), F.expr("cast(NULL AS ARRAY<DOUBLE>)")),
        "vec_f32('[1 2,]')": vec.f32(F.lit("[1 2,]")), "vec_f32(' [ -1.5e1, .5 ] rest')": vec.f32(F.lit(" [ -1.5e1, .5 ] rest")), "vec_f32(NULL)": vec.f32(F.lit(None).cast("string")),
        "vec_normalize(array(3D, 4D))": vec.normalize(F.expr("array(3D, 4D)")), "vec_normalize(array(0D))": vec.normalize(F.expr("array(0D)")),
        "vec_slice(array(1D, 2D, 3D), 1, 3)": vec.slice(F.expr("array(1f, 2f, 3f)"), 1, 3),
        "vec_add_int8(array(120Y), array(10Y))": vec.add(F.expr("array(120Y)"), F.expr("array(10Y)"), "int8"), "vec_sub_int8(array(-120Y), array(10Y))": vec.sub(F.expr("array(-120Y)"), F.expr("array(10Y)"), "int8"),
        "vec_quantize_int8(array(-2D, 0D, 1D, double('NaN')), 'unit')": vec.quantize_int8(F.expr("array(-2D, 0D, 1D, double('NaN'))")),
        "vec_quantize_binary(array(1D, -1D, 1D, 0D, 0D, 0D, 0D, 2D))": vec.quantize_binary(F.expr("array(1D, -1D, 1D, 0D, 0D, 0D, 0D, 2D)")),
        "vec_int8('[1,-128]')": vec.int8_json(F.lit("[1,-128]")), "vec_bit(X'0102')": vec.bit(F.expr("X'0102'")), "vec_to_json(array(1D, double('NaN')))": vec.to_json(F.expr("array(1D, double('NaN'))")),
        "vec_distance_cosine(array(1D, 0D), array(0D, 2D))": vec.distance_cosine(F.expr("array(1D, 0D)"), F.expr("array(0D, 2D)")), "vec_distance_hamming(array(7L), array(1L))": vec.distance_hamming(F.expr("array(7L)"), F.expr("array(1L)")),
    }
    for text, column in both.items():
        assert str(sql(text)) == str(one.select(column.alias("x")).head().x), text
    assert sql("vec_type(typeof(array(1f)))") == "float32" and sql("vec_type(typeof(array(1Y)))") == "int8" and "Version" in sql("vec_debug()") and sql("vec_length_bit(X'00')") == 8


@pytest.mark.parametrize("text", [
    "vec_distance_l2(array(1D, 2D), array(1D))", "vec_dot(array(), array())", "vec_add(array(1D), array(1D, 2D))", "vec_distance_hamming(array(1L), array(1L, 2L))", "vec_slice(array(1D, 2D), 1, 5)",
    "vec_slice(array(1D, 2D), -1, 1)", "vec_slice(array(1D, 2D), 1, 1)", "vec_f32('nope')", "vec_f32('[]')", "vec_int8('[200]')", "vec_quantize_binary(array(1D))", "vec_quantize_int8(array(1D), 'other')", "vec_bit(X'')",
    "vec_type('string')"])
def test_sql_functions_refuse_what_the_columns_refuse(sql, text):
    with pytest.raises(Exception, match="USER_RAISED|raise|dimension"):
        sql(text)


def test_table_functions(spark, tmp_path):
    import numpy as np

    vec.register(spark)
    np.save(tmp_path / "a.npy", np.arange(6, dtype="<f4").reshape(3, 2))
    got = spark.sql(f"SELECT p.path IS NULL AS none, rowid, vector FROM VALUES ('{tmp_path}/a.npy'), (NULL) AS p(path), LATERAL npy_each(p.path)").collect()
    assert [(r.rowid, r.vector) for r in got] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert [tuple(r) for r in spark.sql("SELECT * FROM vec_each(array(5D, 7D))").collect()] == [(0, 5.0), (1, 7.0)]


def test_half_of_a_store_merged_into_another_is_the_whole(spark, tmp_path):
    a, b, whole = (Palace.open(spark, str(tmp_path / x), dim=8) for x in ("a", "b", "whole"))
    for n, (text, wing) in enumerate([("one", "w"), ("two", "w"), ("three", "v"), ("four", "v")]):
        for p in ((a if n % 2 else b), whole):
            p.store(text, wing, room=f"r{n % 3}", now=n)
    for p, names in ((a, "x y"), (b, "y z"), (whole, "x y z")):
        p.see_entities(spark.createDataFrame([(n, "t") for n in names.split()], "name string, entity_type string"), 5)
        at = {r.name: r.id for r in p.table("entities").collect()}
        p.add_edges(spark.createDataFrame([(at[s], "knows", at[o]) for s, o in zip(names.split(), names.split()[1:])], "subject_id long, predicate string, object_id long"), 6)
    b.export(str(tmp_path / "out"))
    assert a.merge(str(tmp_path / "out"))["drawers"] == 2 and a.merge(str(tmp_path / "out")) == {t: 0 for t in ("wings", "rooms", "drawers", "vec_drawers", "entities", "relationships")}
    shown = lambda p: sorted((r.content, r.wing_name, r.room_name) for r in p.search("one", 10, now=9).collect())
    graph_of = lambda p: sorted((r.subject, r.predicate, r.object) for r in p.edges().collect())
    assert shown(a) == shown(whole) and graph_of(a) == graph_of(whole) and a.stats().head() == whole.stats().head()
    b.export(str(tmp_path / "wing"), wing="v")
    assert spark.read.parquet(str(tmp_path / "wing" / "drawers")).count() == 1


def test_palaces_of_two_threads(spark, tmp_path):
    path, errors = str(tmp_path / "p"), []

    def write(k):
        try:
            mine = Palace.open(spark, path, dim=8)
            for n in range(3):
                mine.store(f"text {n}" if n == 0 else f"text {k} {n}", f"wing {n}", now=n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    p, began = Palace.open(spark, path, dim=8), time.time()
    assert not errors and sorted(r.content for r in p.table("drawers").collect()) == ["text 0", "text 1 1", "text 1 2", "text 2 1", "text 2 2"]
    assert ids(p.table("drawers")) == [1, 2, 3, 4, 5] == ids(p.table("vec_drawers")) and p.stats().head().drawers == 5 and p.stats().head().wings == 3 and time.time() > began


def test_the_package_can_be_shipped(tmp_path):
    import subprocess
    import sys

    from tessera.shipping import packed

    packed(str(tmp_path / "t.zip"))
    said = subprocess.run([sys.executable, "-c", "import tessera.plans.registry as r, tessera; print(len(r.QUERIES), tessera.__file__)"], env={**os.environ, "PYTHONPATH": str(tmp_path / "t.zip")},
                          cwd=tmp_path, capture_output=True, text=True)
    assert "t.zip" in said.stdout and int(said.stdout.split()[0]) > 90


def test_ignore_globs(spark):
    from tessera.functions import text

    cases = {
        "*.py": (["a.py", "x/y.py", "a.py/z"], ["a.pyc", "apy"]), "build/": (["build/a", "x/build/y/z"], ["build", "rebuild/a"]), "/top.txt": (["top.txt"], ["x/top.txt"]),
        "doc/*.txt": (["doc/a.txt"], ["doc/x/a.txt", "x/doc/a.txt"]), "**/deep": (["deep", "a/b/deep", "a/deep/c"], ["adeep"]), "a/**/b": (["a/b", "a/x/y/b"], ["ab", "x/a/b"]), "f[0-3]?.md": (["f1x.md", "d/f3y.md"], ["f4x.md", "f1.md"]),
        "f[!0-3].md": (["fa.md"], ["f2.md"]), "a+b(c).txt": (["a+b(c).txt"], ["aab(c).txt"]), "x/**": (["x/a", "x/a/b"], ["x", "y/x/a"])}
    for glob, (out, kept) in cases.items():
        df = spark.createDataFrame([(p,) for p in out + kept], "path string")
        got = {r.path for r in df.where(text.ignored(F.col("path"), [glob])).collect()}
        assert got == set(out), glob
    df = spark.createDataFrame([("a.log",), ("keep.log",), ("b.txt",)], "path string")
    assert [r.path for r in df.where(text.ignored(F.col("path"), ["*.log", "", "# x", "!keep.log"])).collect()] == ["a.log"]


def test_only_changed_files_are_read_again(spark, tmp_path):
    folder = tmp_path / "project"
    folder.mkdir()
    for n in ("a.md", "b.md", "c.log"):
        (folder / n).write_text(f"text of {n}")
    palace = Palace.open(spark, str(tmp_path / "s"), dim=8)
    run = lambda: palace.mine(str(folder), "w", now=1, ignore=["*.log"], changed_only=True)
    first = run()
    assert (first.files_processed, first.files_skipped, first.drawers_inserted) == (2, 0, 2)
    again = run()
    assert (again.files_processed, again.files_skipped, again.chunks_seen, again.drawers_inserted) == (0, 2, 0, 0)
    (folder / "a.md").write_text("text of a.md, longer now")
    third = run()
    assert (third.files_processed, third.files_skipped, third.drawers_inserted) == (1, 1, 1)
    assert palace.table("mined_files").count() == 2 and palace.db.rows("mined_files") == 2
    assert palace.mine(str(folder), "w", now=1).files_processed == 3
