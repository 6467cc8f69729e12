"""The inverted index, the inverted file of vectors, exact batches, streams of windows, joins as of a time."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.ivf import ODD, IvfIndex
from tessera.operators.knn import knn, knn_join
from tessera.operators.text_index import TextIndex, fused, postings
from tessera.plans.registry import QUERIES
from tessera.streaming.windows import event_windows, window_stream

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def bm25(texts, query):
    """{id: score} by the formula."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    n, average, out = len(texts), sum(map(len, words.values())) / len(texts), {}
    for term in set(re.findall(r"[^\W_]+", query.lower())):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
    return out


def test_bm25_matches_the_formula(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma", "délta", "x1", "the"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    texts += [(900, None), (901, ""), (902, "?!"), (903, "the " * 400)]
    df = spark.createDataFrame(texts, "id long, content string")
    index = TextIndex.build(df.where("id < 120"), str(tmp_path / "a"), buckets=4)
    index.add(df.where("id >= 120"))
    for query in ("alpha", "The délta, gamma the", "nothing known", "", "x1 x1 beta"):
        want = sorted(((-round(s, 9), i) for i, s in bm25(texts, query).items()))[:7]
        got = [(-r.score, r.id) for r in index.search(query, 7).collect()]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    asked = spark.createDataFrame([(1, "alpha"), (2, None), (3, "zzz"), (4, "x1 gamma")], "query_id long, text string")
    rows = index.search_join(asked, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"]) for r in rows] == [(1, 1), (1, 2), (1, 3), (4, 1), (4, 2), (4, 3)]
    assert [r.id for r in rows[:3]] == [r.id for r in index.search("alpha", 3).collect()]
    with pytest.raises(ValueError):
        index.search("a", 5000)
    empty = TextIndex.build(df.limit(0), str(tmp_path / "b"))
    assert empty.search("alpha", 3).count() == 0


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("word"), F.col("id") % 500, F.lit(" other"), F.col("id") % 7).alias("content"))
    index = TextIndex.build(df, str(tmp_path / "a"), buckets=16)
    found = index.search("word17", 5)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*bucket", text) and re.search(r"PushedFilters: \[.*term,word17", text)
    assert [r.id for r in found.collect()] == [17, 517, 1017, 1517, 2017]
    parts = index.sizes()[0]
    posted = spark.read.parquet(f"{tmp_path}/a/postings/part={parts[0]}")
    assert posted.select("bucket").distinct().count() > 8 and posted.where("term = 'word17'").select("bucket").distinct().count() == 1


def test_lists_are_fused_by_rank(spark):
    near = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, distance double")
    ranked = spark.createDataFrame([(3, 9.0), (4, 8.0)], "id long, score double")
    got = [(r.id, r.distance, r.bm25, r.score) for r in fused(near, ranked, 3).collect()]
    assert got == [(3, 0.3, 9.0, round(1 / 63 + 1 / 61, 9)), (1, 0.1, None, round(1 / 61, 9)), (2, 0.2, None, round(1 / 62, 9))]


def made_vectors(spark, n, d, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d)) * 4
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>"), x.astype(np.float32).astype(np.float64)


def test_ivf_reads_only_its_cells_and_recalls(spark, tmp_path):
    df, x = made_vectors(spark, 3000, 16)
    odd = spark.createDataFrame([(9000, [0.0] * 16), (9001, [float("nan")] * 16), (9002, None)], "id long, embedding array<float>")
    for metric in ("l2", "cosine"):
        index = IvfIndex.build(df.unionByName(odd), str(tmp_path / metric), cells=24, metric=metric)
        assert len(index.cells) == 24 and index.table().count() == 3002 and index.table().where(F.col("cell") == ODD).count() == 2
        query = x[5].tolist()
        same = lambda a, b: [(r.id, r.distance) for r in a.collect()] == [(r.id, r.distance) for r in b.collect()]
        assert same(index.knn(query, 8, probes=24), knn(df.unionByName(odd), query, 8, metric=metric))
        few = index.knn(query, 8, probes=2)
        assert "PartitionFilters: [" in plan(few) and re.search(r"PartitionFilters: \[.*cell", plan(few))
        asked = df.where("id % 30 = 0").withColumnRenamed("id", "query_id")
        exact = {(r.query_id, r.id) for r in knn_join(asked, df, 10, metric=metric).collect()}
        got = {(r.query_id, r.id) for r in index.knn_join(asked, 10, probes=12).collect()}
        assert len(exact & got) >= 0.95 * len(exact)
        every = {(r.query_id, r.id, r["rank"]) for r in index.knn_join(asked, 10, probes=24).collect()}
        assert every == {(r.query_id, r.id, r["rank"]) for r in knn_join(asked, df, 10, metric=metric).collect()}
    with pytest.raises(ValueError):
        index.knn(query, 8, probes=0)
    with pytest.raises(ValueError):
        IvfIndex.build(df, str(tmp_path / "l1"), metric="l1")
    nothing = IvfIndex.build(df.limit(0), str(tmp_path / "none"))
    assert nothing.knn(query, 3, probes=1).count() == 0


@pytest.mark.parametrize("offset,noise", [(1e4, 1e-3), (100.0, 1e-5), (1.0, 1.0), (0.0, 1e-160), (1e160, 1e150)])
def test_batches_are_exact_on_any_norms(spark, offset, noise):
    rng = np.random.default_rng(3)
    x = offset + noise * rng.standard_normal((3000, 64))
    q = offset + noise * rng.standard_normal((100, 64))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    with np.errstate(over="ignore"):
        want = {i: np.lexsort((np.arange(3000), np.sqrt(((x - v) ** 2).sum(axis=1))))[:10].tolist() for i, v in enumerate(q)}
    for parts in (1, 4):
        got = {}
        for r in knn_join(asked, corpus.repartition(parts), 10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_batches_put_nan_distances_last(spark):
    nan = float("nan")
    corpus = spark.createDataFrame([(1, [nan, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    ids = lambda metric, k: [r.id for r in knn_join(asked, corpus, k, metric=metric).orderBy("rank").collect()]
    assert ids("l2", 4) == [3, 5, 2, 1] and ids("l2", 2) == [3, 5] and ids("l1", 3) == [3, 5, 2] and ids("cosine", 4) == [2, 3, 1, 5]


def test_windows_drop_late_and_repeated_events(spark, tmp_path):
    kind = "event_id long, ts timestamp, event_type string, value double"
    import datetime as dt

    at = lambda day, hour=0: dt.datetime(2024, 3, day, hour)
    run = lambda: window_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, str(tmp_path / "out"), str(tmp_path / "state"), delay="1 day").awaitTermination()
    feed = lambda name, *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    feed("a", (1, at(1, 5), "a", 1.0), (2, at(1, 6), "a", 2.0), (2, at(1, 6), "a", 2.0), (3, at(3, 12), "b", 4.0))
    run()
    feed("b", (4, at(1, 7), "a", 8.0), (5, at(2, 13), "a", 16.0), (3, at(3, 12), "b", 4.0))  # the watermark is at the 2nd, 12 o'clock
    run()
    feed("c", (9, at(20), "z", 0.0))
    run()
    got = {(r.window_start, r.event_type): (r.events, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(at(1), "a"): (2, 3.0), (at(2), "a"): (1, 16.0), (at(3), "b"): (1, 4.0)}
    batch = event_windows(spark.createDataFrame([(1, at(1), "a", 1.0), (1, at(1), "a", 1.0)], kind)).collect()
    assert [(r.events, r.total) for r in batch] == [(1, 1.0)]


def test_as_of_join_matches_brute_force_without_a_nested_loop(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(5), f := rng.randrange(0, 5000), rng.choice([None, f, f + rng.randrange(1, 20), f + rng.randrange(1, 4000)])) for i in range(300)]
    probes = [(i, rng.randrange(6), rng.randrange(-10, 6000)) for i in range(200)]
    e = spark.createDataFrame([(i, s, "p", 1, f, u) for i, s, f, u in edges], "id long, subject_id long, predicate string, object_id long, valid_from long, valid_until long")
    p = spark.createDataFrame(probes, "probe_id long, subject_id long, at long")
    out = graph.as_of_join(p, e, bucket=50)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = sorted((r.probe_id, r.id) for r in out.collect())
    assert got == sorted((i, j) for i, s, t in probes for j, s2, f, u in edges if s == s2 and f <= t and (u is None or u > t))
    assert graph.as_of_join(p.limit(0), e).count() == 0


def test_partition_values_of_a_query_prune_at_run_time(spark):
    df = QUERIES["knn_partition_in_query"](spark, "/root/testdata/sf0.01")
    assert "dynamicpruning" in plan(df) and df.count() == 10


def test_probes_grow_with_cells_of_vectors_that_do_not_cluster(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    asked = df.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in knn_join(asked, df, 10).collect()}
    index = IvfIndex.build(df, str(tmp_path / "a"))
    found = lambda probes: len(exact & {(r.query_id, r.id) for r in index.knn_join(asked, 10, probes).collect()})
    probes = index.probes_for(0.985, 10)
    assert 32 < probes < len(index.cells) and found(32) < 0.95 * len(exact) <= found(probes)
    assert IvfIndex.build(df.limit(0), str(tmp_path / "none")).probes_for(0.9, 10) == 1


def test_postings_are_counted_without_a_shuffle(spark, tmp_path):
    texts = [(i, " ".join(random.Random(i).choices(["a", "b", "Ç", "x1", "zz"], k=i % 40))) for i in range(300)] + [(900, None), (901, "?!")]
    df = spark.createDataFrame(texts, "id long, content string")
    rows = postings(df)
    assert "Exchange" not in plan(rows)
    want = sorted((t, i, len([w for w in ws if w == t]), len(ws)) for i, x in texts for ws in [(x or "").lower().replace("?!", "").split()] for t in set(ws))
    assert sorted(map(tuple, rows.collect())) == want
    # rows of one id count as one where they are as long
    twice = spark.createDataFrame([(1, "a b a"), (1, "a a c"), (1, "a"), (2, "a"), (None, "b"), (None, "b")], "id long, content string")
    assert sorted(map(tuple, postings(twice).collect()), key=repr) == sorted([("a", 1, 4, 3), ("b", 1, 1, 3), ("c", 1, 1, 3), ("a", 1, 1, 1), ("a", 2, 1, 1), ("b", None, 2, 1)], key=repr)
    index = TextIndex.build(df, str(tmp_path / "a"), buckets=4)
    assert index.sizes()[2] == 302 and index.sizes()[3] == sum(len((x or "").replace("?!", "").split()) for _, x in texts) / 302
    asked = spark.createDataFrame([(1, "a b"), (2, "b x1"), (3, "a zz")], "query_id long, text string")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    text = plan(index.search_join(spark.read.parquet(str(tmp_path / "asked")), 3))
    assert "hashpartitioning(id" in text and not re.search(r"hashpartitioning\(query_id#\d+L?, id", text)


def test_intervals_are_cut_into_few_pieces_whatever_their_length(spark):
    rng = random.Random(6)
    for unit in (60, 400 * 86400):
        edges = [(i, rng.randrange(5), f := rng.randrange(0, 50 * unit), f + rng.randrange(1, 20 * unit)) for i in range(300)]
        probes = [(i, rng.randrange(6), rng.randrange(0, 70 * unit)) for i in range(200)]
        e = spark.createDataFrame([(i, s, "p", 1, f, u) for i, s, f, u in edges], "id long, subject_id long, predicate string, object_id long, valid_from long, valid_until long")
        out = graph.as_of_join(spark.createDataFrame(probes, "probe_id long, subject_id long, at long"), e)
        assert sorted((r.probe_id, r.id) for r in out.collect()) == sorted((i, j) for i, s, t in probes for j, s2, f, u in edges if s == s2 and f <= t < u)
        width = int(re.search(r"FLOOR\(\(cast\(at#\d+L as double\) / cast\((\d+) as double\)", out._jdf.queryExecution().analyzed().toString()).group(1))
        assert sum(u // width - f // width + 1 for _, _, f, u in edges) < 3 * len(edges)
