"""Operator 10, quality classifier: compression with zstandard dictionaries of good and of bad text.

The dictionaries are trained by zstandard, in tasks, from the whole texts of one half of a sample of labelled rows. A
text's feature is the difference of its compressed sizes under the two kinds, by its length; isotonic steps fitted on
the other half, which no dictionary has seen, turn it into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, held_out, labelled_sample, materialise

#: Labelled rows to learn from at most (the one bound on what is learned), each dictionary's size, the level.
SAMPLE_ROWS, DICT_BYTES, LEVEL = 12_000, 110_000, 3
#: Bytes of text of one training task about: a label with more has several dictionaries. Segment and match of the trainer.
PART_BYTES, SEGMENT, MATCH = 64 << 20, 1000, 8
#: A text goes to the trainer in pieces of this size, all of them, as it looks for what pieces have in common.
PIECE = 1 << 14
ACCEPT = 0.3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries by label (0: bad, 1: good), and the knots of the calibration."""

    dictionaries: dict[int, list[bytes]]
    xs: tuple[float, ...] = (0.0,)
    ys: tuple[float, ...] = (0.5,)


def _coders(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in dictionaries]


def sizes(raw: bytes, coders: list[zstandard.ZstdCompressor]) -> int:
    """Bytes of raw, compressed with the one of a label's dictionaries that fits it best."""
    return min(len(c.compress(raw)) for c in coders)


def differences(texts: list[str | None], dictionaries: dict[int, list[bytes]]) -> np.ndarray:
    """(size under bad dictionaries - size under good ones) / bytes of the text, whole texts; 0 for empty ones."""
    out = np.zeros(len(texts))
    if all(dictionaries.get(k) for k in (0, 1)):
        bad, good = (_coders(dictionaries[k]) for k in (0, 1))
        for i, t in enumerate(texts):
            if t:
                raw = t.encode("utf-8", "surrogatepass")
                out[i] = (sizes(raw, bad) - sizes(raw, good)) / len(raw)
    return out


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained from whole texts. Where they are too few to train, the texts themselves are the dictionary."""
    samples = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts).ljust(64)


def isotonic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a non-decreasing map from x to the mean of y, between 0 and 1."""
    if not len(x):
        return np.array([0.0]), np.array([prior])
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest x, highest x
    for v, t in zip(x[order], y[order]):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    knots = [(e, (s + prior) / (n + 1)) for s, n, lo, hi in blocks for e in ((lo, hi) if hi > lo else (lo,))]
    xs, ys = np.array(knots).T
    return xs, np.maximum.accumulate(ys)


def train(sample: DataFrame) -> CompressionModel:
    """Fit on (doc_id, text, label), whose rows the caller bounds. Half of the rows, by a hash of their id, train the
    dictionaries, a task for each PART_BYTES of a label's text; the driver receives the dictionaries, and of the other
    half a difference and a label a row."""
    rows = materialise(sample.select("label", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("half"), F.xxhash64("doc_id", F.lit(4)).alias("place")), "quality-sample")
    size = F.octet_length("text").cast("long")
    parts = rows.where("half = 0").groupBy("label").agg((F.floor(F.sum(size) / PART_BYTES) + 1).cast("int").alias("parts"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode("utf-8", "surrogatepass") for t in frame.sort_values(["place", "text"])["text"] if t]
        return pd.DataFrame({"label": frame["label"].iloc[:1], "part": frame["part"].iloc[:1], "dictionary": [dictionary(texts)] if texts else [None]})

    fitting = rows.where("half = 0").join(F.broadcast(parts), "label").withColumn("part", F.pmod("place", F.col("parts")).cast("int"))
    found: dict[int, list[bytes]] = {}
    for r in fitting.groupBy("label", "part").applyInPandas(learn, "label int, part int, dictionary binary").orderBy("label", "part").collect():
        if r["dictionary"]:
            found.setdefault(r["label"], []).append(bytes(r["dictionary"]))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": differences(f["text"].tolist(), found), "y": f["label"].astype(float)})

    seen = rows.where("half = 1").select("text", "label").mapInPandas(compare, "x double, y double").orderBy("x", "y").toPandas()
    share = rows.agg(F.avg("label")).head()[0]
    xs, ys = isotonic(seen["x"].to_numpy(), seen["y"].to_numpy(), 0.5 if share is None else float(share))
    return CompressionModel(found, tuple(xs), tuple(ys))


def score(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference, score) of every row's whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = differences(f["text"].tolist(), model.dictionaries)
            yield pd.DataFrame({"id": f["id"], "difference": d, "score": np.interp(d, model.xs, model.ys)})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, difference double, score double").withColumnRenamed("id", id_col)


def quality_classifier(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of df: doc_id, held_out, score (0 to 1, higher is better), predicted, difference.

    Null and empty texts have difference 0 and the score at 0. Texts count whole, at any length. Without labelled rows
    the score is 0.5; where they are all of one label, or too few for the calibration, it is the share of label 1. An id
    that several rows have teaches once; a row with a null id is scored, not held out, and teaches nothing. Repeated rows are
    each scored; columns besides doc_id and text are ignored.
    """
    model = train(labelled_sample(df, labels, "quality", SAMPLE_ROWS))
    return score(df, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "difference")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
