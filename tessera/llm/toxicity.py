"""Operator 5, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are native columns over the whole text; trees and calibration are Spark ML's. The lexicon is a
short general list and the words that a bounded sample of labelled texts shows to mark toxic ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, held_out, labelled_sample, materialise, text_or_empty

#: Labelled rows to learn from at most, and what a word must show there to join the lexicon.
SAMPLE_ROWS, WORD_ROWS, WORD_SHARE = 16_000, 5, 0.97
#: Lengths of the word beginnings that may join it too, as "stem*".
STEMS = (4, 5, 6)
#: A general list to start from.
INSULTS = ["asshole", "bastard", "bitch", "clown", "crap", "disgusting", "dumb", "filth", "fool", "freak", "idiot", "imbecile", "jerk", "loser",
           "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
SECOND_PERSON = ["you", "your", "youre", "yourself", "u", "ur", "du", "dich", "dir", "dein", "tu", "te", "toi", "ton", "vous", "votre", "usted", "ti"]
#: Characters that stand for letters in obfuscated words.
LOOKALIKE = ("01345@$!", "oieasasi")
LETTER = r"[\p{L}\p{M}]"
FEATURES = ["lexicon_hits", "lexicon_density", "lexicon_kinds", "near_you", "capitals", "punctuation", "exclamations", "obfuscation", "log_words"]


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def trie(words: list[str]) -> str:
    """A pattern for any of the words that looks at each letter once; "stem*" stands for all words that begin so."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    if "*" in heads:
        return rf"{LETTER}*+"
    parts = [re.escape(h) + (trie(rest) if rest != [""] else "") for h, rest in heads.items() if h]
    return ("(?:" + "|".join(parts) + ")" + "?" * ("" in heads)) if len(parts) > 1 or "" in heads else parts[0]


def _any(words: list[str]) -> str:
    return rf"(?<!{LETTER}){trie(words)}(?!{LETTER})"


def _less(text: Column, low: Column, chars: str) -> Column:
    """How many characters of chars low has."""
    return F.length(low) - F.length(F.translate(low, chars, ""))


def features(df: DataFrame, lexicon: list[str]) -> DataFrame:
    """df (doc_id, text, ...) without text, with FEATURES: counts and rates over the whole text."""
    text, low = F.col("text"), F.col("_low")
    undone = F.translate(F.regexp_replace(F.regexp_replace(low, rf"[!$@](?!{LETTER})", " "), rf"(?<={LETTER})[*._-](?={LETTER})", ""), *LOOKALIKE)
    hits, plain = F.col("lexicon_hits"), F.regexp_count(low, F.lit(_any(lexicon)))
    you = rf"(?<!{LETTER})(?:{'|'.join(SECOND_PERSON)})(?!{LETTER})[^\p{{L}}]+(?:{LETTER}+[^\p{{L}}]+){{0,3}}?"
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    out = df.withColumn("_low", F.lower(text)).withColumns({
        "log_words": F.log1p((F.length(text) - F.length(F.translate(text, " \n\t", ""))).cast("double")),
        "_plain": plain.cast("double"),
        "_undone": F.when(low.rlike(r"[0-9@$!*._-]" + LETTER), F.regexp_count(undone, F.lit(_any(lexicon)))).cast("double"),
        "capitals": _less(text, text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        "punctuation": _less(text, text, ".,;:?!'\"()-") / size,
        "exclamations": _less(text, text, "!") / size,
    }).withColumns({
        "lexicon_hits": F.greatest("_plain", F.coalesce("_undone", F.lit(0.0))),
    }).withColumns({
        "obfuscation": hits - F.col("_plain"),
        "lexicon_density": hits / (1 + F.exp("log_words")),
        "lexicon_kinds": F.when(hits > 0, F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({_any(lexicon)})"), F.lit(1))))).otherwise(0).cast("double"),
        "near_you": F.when(hits > 0, F.regexp_count(low, F.lit(you + _any(lexicon)))).otherwise(0).cast("double"),
    })
    return out.drop("text", "_low", "_plain", "_undone")


def learned_words(sample: DataFrame) -> list[str]:
    """All words of the sample, and beginnings of words, in at least WORD_ROWS rows of which WORD_SHARE are toxic, best first.
    The sample bounds them."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    terms = sample.select("label", F.explode(F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 2), *stems))).alias("word"))
    found = (
        terms.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"))
        .where((F.col("n") >= WORD_ROWS) & (F.col("share") >= WORD_SHARE))
        .orderBy(F.desc("n"), "word")
    )
    return [r["word"] for r in found.collect()]


def train(sample: DataFrame) -> ToxicityModel:
    """Fit on (doc_id, text, label), which the caller bounds: trees on three quarters, calibration on the rest."""
    sample = materialise(sample.select("doc_id", "text", "label").repartition(12), "toxic-sample")
    fit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) > 0
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    prior = seen.get(1, 0) / max(1, sum(seen.values()))
    lexicon = sorted({*INSULTS, *learned_words(sample.where(fit))})
    if len(seen) < 2:
        return ToxicityModel(lexicon, None, None, prior if seen else 0.0)
    rows = materialise(features(sample, lexicon).withColumn("fit", fit), "toxic-features").coalesce(6)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    kinds = rows.groupBy("fit").agg(F.countDistinct("label").alias("n")).collect()
    if any(r["n"] < 2 for r in kinds) or len(kinds) < 2:  # too few rows to keep some apart
        rows = rows.withColumn("fit", F.lit(True))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=10, maxDepth=3, maxBins=32, stepSize=0.3, seed=1).fit(rows.where("fit"))
    held = rows if len(kinds) < 2 or any(r["n"] < 2 for r in kinds) else rows.where(~F.col("fit"))
    raw = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw)
    return ToxicityModel(lexicon, trees, steps, prior)


def score(df: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, FEATURES, score) for every row of df; text is among its columns."""
    rows = features(df.select(*keep, text_or_empty().alias("text")), model.lexicon)
    if model.trees is None:
        return rows.withColumn("score", F.lit(float(model.prior)))
    rows = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    rows = model.steps.transform(rows.drop("prediction").withColumn("raw", vector_to_array("probability")[1]))
    return rows.select(*keep, *FEATURES, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))


def keep_clean(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of df that score below 0.5, with all their columns in their order."""
    rows = score(df.select(F.struct("*").alias("_row"), "text"), model, ("_row",))
    return rows.where("score < 0.5").select("_row.*")


def toxicity(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of df: doc_id, held_out, score (0 to 1, higher is likelier toxic), predicted, and the features.

    Null texts count as empty; texts count whole. Labels of held-out rows are never read into training. If the
    labels have one class or none, the score is its share (0 without labels). A row with a null id is scored, not held
    out, and teaches nothing. Repeated rows are each scored; columns besides doc_id and text are ignored.
    """
    model = train(labelled_sample(df, labels, "toxic", rows))
    return score(df, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
