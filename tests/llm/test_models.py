import random
import zlib

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import documents
from tests.llm.conftest import SF

LARGE = "/root/testdata/sf0.1"


def accuracy(df, labels, label):
    rows = df.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r.y for r in rows]), np.array([r.predicted for r in rows])


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op5_toxicity, "toxic", 0.97), (quality.op10_quality_classifier, "quality", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    df = query(spark, LARGE).cache()
    assert df.count() == documents(spark, LARGE).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in df.collect())
    score, y, predicted = accuracy(df, documents(spark, LARGE, "labels"), label)
    assert auc(score, y) >= least and np.mean(predicted == y) >= 0.85


def test_toxicity_edges(spark, awkward, nothing, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    train = docs([(i, "you stupid worthless idiot" if i % 2 else "a calm and plain sentence") for i in range(60)])
    got = {r.doc_id: r for r in toxicity.toxicity(train, labels).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[1].near_you == 1
    model = toxicity.train(train.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id"))
    clean = toxicity.keep_clean(awkward, model)
    assert clean.columns == awkward.columns and clean.count() == 11
    assert toxicity.keep_clean(nothing, model).count() == 0
    assert toxicity.toxicity(awkward, labels.limit(0)).where("score = 0").count() == 11
    shown = toxicity.features(docs([(1, "You are a l0s3r, an id-i*ot! " * 3)]).select("doc_id", "text"), toxicity.INSULTS).head()
    assert shown.lexicon_hits == 6 and shown.obfuscation == 6


def test_quality_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert quality.quality_classifier(awkward, labels).count() == 11
    assert quality.quality_classifier(nothing, labels).count() == 0
    assert all(r.score == 0.5 for r in quality.quality_classifier(awkward, labels.limit(0)).collect())


def test_quality_score_is_the_difference_of_compressed_sizes(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice("gold silver bronze copper iron".split() if i % 2 else "mud dust sand gravel stone".split(), 40 + i))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(quality.labelled_sample(docs(rows), labels, "quality", 150))
    assert sorted(model.dictionaries) == [0, 1] and all(len(d) == 1 for d in model.dictionaries.values())

    def size(raw, d):
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw))

    for r in quality.score(docs([*rows[:20], (900, None), (901, "")]), model).collect():
        raw = (dict(rows).get(r.doc_id) or "").encode()
        want = (size(raw, model.dictionaries[0][0]) - size(raw, model.dictionaries[1][0])) / len(raw) if raw else 0.0
        assert r.difference == want and r.score == np.interp(want, model.xs, model.ys)
    got = quality.quality_classifier(docs(rows), labels).where("held_out").collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_a_repeated_id_teaches_once(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs([(3, "a"), (3, "b"), (3, None), (4, None), (100, "c")]), labels, "quality", 50)
    assert set(map(tuple, sample.select("doc_id", "label", "text").collect())) <= {(3, 1, "b"), (4, 0, "")} and sample.count() <= 2


def test_texts_of_a_label_beyond_one_task_make_more_dictionaries(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "PART_BYTES", 20_000)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green"] if i % 2 else ["one", "two", "three"], 200))) for i in range(400)]
    model = quality.train(docs(rows).selectExpr("doc_id", "text", "cast(doc_id % 2 AS int) AS label"))
    assert all(len(d) > 1 for d in model.dictionaries.values())
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in quality.score(docs(rows), model).collect())


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500).round(1)
    xs, ys = quality.isotonic(x, (x + rng.normal(size=500) > 0).astype(float), 0.5)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and ys[0] < 0.2 < 0.8 < ys[-1]


def plain_features(text, lexicon):
    """The features by their definitions: every run of letters is looked up."""
    letter = r"[\p{L}\p{M}]"
    text = text or ""
    low = text.lower()
    known = lambda w: w in lexicon or any(s.endswith("*") and w.startswith(s[:-1]) for s in lexicon)
    runs = lambda t: [w for w in regex.findall(f"{letter}+", t) if known(w)]
    undone = regex.sub(rf"(?<={letter})[*._-](?={letter})", "", regex.sub(rf"[!$@](?!{letter})", " ", low)).translate(str.maketrans(*toxicity.LOOKALIKE))
    plain = len(runs(low))
    hits = max(plain, len(runs(undone)) if regex.search(rf"[0-9@$!*._-]{letter}", low) else 0)
    near, at = 0, 0
    while hits and at <= len(low):  # the shortest way from a pronoun to a known word
        found = None
        for m in regex.finditer(rf"(?<!{letter})(?:{'|'.join(toxicity.SECOND_PERSON)})(?!{letter})", low, pos=at):
            for k in range(4):
                n = regex.compile(rf"[^\p{{L}}]+(?:{letter}+[^\p{{L}}]+){{{k}}}({letter}+)(?!{letter})").match(low, m.end())
                if n and known(n[1]) and not regex.match(letter, low[n.start(1) - 1]):
                    found = n
                    break
            if found:
                break
        if not found:
            break
        near, at = near + 1, found.end()
    size, blanks = max(1, len(text)), sum(c in " \n\t" for c in text)
    return {"lexicon_hits": hits, "lexicon_density": hits / (1 + blanks + 1), "lexicon_kinds": len(set(runs(low))) if hits else 0, "near_you": near, "capitals": sum("A" <= c <= "Z" for c in text) / size,
            "punctuation": sum(c in ".,;:?!'\"()-" for c in text) / size, "exclamations": text.count("!") / size, "obfuscation": hits - plain, "log_words": np.log1p(blanks)}


def test_features_match_their_definitions(spark):
    rng = random.Random(12)
    lexicon = sorted({*toxicity.INSULTS, "lowe*", "réê*", "zutx"})
    words = ["you", "your", "a", "the", "idiot", "IDIOT", "1d10t", "i.d.i.o.t", "st*pid", "stupid!", "l0ser", "lowering", "lower", "Réêou", "idiots", "xidiot", "scum,", "du", "$cum", "w-o-r-t-h-l-e-s-s", "né", "zutx", "42", "you're", "clown."]
    texts = [None, "", "you", "you idiot", "YOU ARE A STUPID clown!!!", "you and all of them are idiot", "idiot you", "you; (idiot)", "é" * 5] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for r in toxicity.features(df, lexicon).collect():
        want = plain_features(texts[r.doc_id], set(lexicon))
        for name in toxicity.FEATURES:
            assert abs(r[name] - want[name]) < 1e-12, (texts[r.doc_id], name, r[name], want[name])
