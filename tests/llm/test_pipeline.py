import corpus_pipeline
from tessera.llm import ngram_join
from tessera.llm.common import documents
from tests.llm.conftest import SF
from tests.llm.test_dedup_license import brute as exact
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_pii import brute as private
from tests.llm.test_tokens_packing import pack_check


def test_stages_match_brute_force(spark, tmp_path):
    docs = documents(spark, SF)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs.collect(), spark.read.parquet(path)
        seen[name] = after = docs.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        ids = lambda rows: sorted(r.doc_id for r in rows)
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            gone = set(ids(before)) - set(ids(after))
            assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone - toxic) <= 0.1 * len(before)
        if name == "exact_dedup":
            assert ids(after) == [r[0] for r in exact(pairs) if r[3]]
        if name == "ngram_jaccard":
            assert ids(after) == sorted(r[0] for r in near(*zip(*pairs), 5, 80, 100) if r[0] == r[2])
        if name == "pii":
            assert ids(after) == ids(before)
            assert all(private(r.text)[1] == [0, 0, 0, 0] and r.n_chars == len(r.text) for r in after)
        if name == "packing":
            assert pack_check(after, dict(pairs), 4096) > 0.9


def test_an_empty_table_passes_through(spark, tmp_path):
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_a_repeated_id_keeps_its_other_texts(spark, docs):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(5, one), (5, two), (3, one + " end"), (9, three), (None, two + " end"), (None, None), (7, ""), (None, "alone in the world here")]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.representatives(docs(rows)).collect()), key=str)
    assert got == sorted([(3, one + " end"), (5, two), (9, three), (None, None), (7, ""), (None, "alone in the world here")], key=str)
    assert ngram_join.representatives(docs(rows)).columns == docs(rows).columns
    same = [(1, one), (1, one + " end"), (1, two)]
    assert [r.text for r in ngram_join.representatives(docs(same)).orderBy("text").collect()] in ([one, two], [one + " end", two])


def test_nulls_repeated_ids_and_clashing_names_pass_through(spark, docs, tmp_path):
    """Every stage over rows with null ids and texts, ids of several texts, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1)), (1, words(2)), (2, words(1) + " more"), (None, words(3)), (None, words(3) + "  "), (None, None), (4, None), (5, ""), (6, words(4) + " mail a@b.cd"), (6, words(4) + " mail a@b.cd"), (7, "w " * 5000)]
    df = docs(rows).withColumns({"n_chars": F.length("text").cast("long"), "lang": F.lit("en"), "source": F.lit("s"), "_gone": F.lit(1), "component_id": F.lit("c"), "whole": F.lit("w"), "kept": F.lit(True), "tag": F.lit(0), "masked": F.lit("m")})
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, SF).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert df.columns == columns
            texts = {r.text for r in df.collect()}
            assert {words(2), words(3)} <= {(t or "").rstrip() for t in texts} and sum((t or "").startswith(words(1)) for t in texts) in (1, 2)
            if name == "ngram_jaccard":
                assert sum((t or "").startswith(words(1)) for t in texts) == 1
            if name == "pii":
                assert words(4) + " mail [EMAIL]" in texts and words(4) + " mail a@b.cd" not in texts
    assert {r.doc_id for r in df.collect()} == {1, 4, 6, 7, None}
