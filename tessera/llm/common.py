"""What the operators share: tables in the shared folder, joins on hot keys, connected components, labels."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.shared import new_path, written  # noqa: F401


#: Lanes over which a key that may hold any share of the rows is spread.
LANES = 64


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and no partitioning is
    assumed of the result, so that a later join shuffles both sides and AQE may split a hot key."""
    return written(df, name)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed now. Spark removes them when the driver's garbage collector finds that
    nothing refers to their plans any more, which may be long after their results were written; a job over many tables
    would hold the disk of all its shuffles till then. Costs a collection of the driver's heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Python workers get batches of about `size` bytes for the tables written meanwhile, whatever the session has: a worker
    holds a batch several times (Arrow, pandas, arrays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn from. A row without an id isn't of them; it has no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents that are not held out, those of the smallest id hashes: (id, text, label).

    The bound keeps training the same size whatever the corpus. Ids of the sample are drawn before texts are
    read, and the id set is bounded by `rows`, so it may be broadcast. An id that several rows have counts once, with
    the last of its texts by their order, so that repeated rows don't widen the sample.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames that come sorted by keys; only one group is held besides the current frame."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        change = np.zeros(len(frame), dtype=bool)
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = frame.iloc[lo:hi]
            if rest and any(rest[-1][k].iloc[-1] != part[k].iloc[0] for k in keys):
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def runs(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Whole groups of frames that come sorted by keys, many in a frame: a group that goes on is held back, and with less
    than `rows` rows all are."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < rows:
            continue
        f = pd.concat(held, ignore_index=True)
        k = f[keys].to_numpy()
        cut = int(np.flatnonzero((k != k[-1]).any(axis=1))[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        held = [f.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def gather(pool: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool (run i has size[i] entries) that pick names, end to end, and the size of each."""
    start, long = np.cumsum(size) - size, size[pick]
    return pool[np.repeat(start[pick] - (np.cumsum(long) - long), long) + np.arange(long.sum())], long


def slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `chars` characters of text, one row at least."""
    size = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(size) - size) // chars
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def spread_join(many: DataFrame, one: DataFrame, key: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one (a row per key), where a key may hold any share of many's rows.

    The rows of a key are dealt to LANES lanes by a hash of `by`; the key's row of `one` goes to the lanes that it is
    in, at most LANES copies, so no task gets more than a lane of a key."""
    many = many.withColumn("_lane", F.pmod(F.xxhash64(*by), F.lit(LANES)).cast("int"))
    seats = many.select(*key, "_lane").distinct().join(one, key)
    return many.join(seats, [*key, "_lane"], how).drop("_lane")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of edges; component is the smallest id reachable, the id itself included.

    Each round hands the labels that moved in the round before over every edge, then follows the label's own label
    (pointer jumping). Who hears of a smaller label tells its old label too, so that whole trees join at once and the
    rounds grow with the logarithm of a chain. A label that didn't move was handed over when it did, so the join
    carries only what is new.
    Minima are partial aggregates; the joins go over lanes (see spread_join), so a hub may hold any share of the edges
    and a component any share of the ids. Rounds end when no label moves; each round's table goes to the shared folder.
    """
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    lane = F.pmod(F.xxhash64("v"), F.lit(LANES)).cast("int")
    both = materialise(pair.union(pair.select("v", "u")).distinct().withColumn("lane", lane), "edges")
    seats = materialise(both.select("u", "lane").distinct(), "edge-seats")
    label = materialise(
        both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
        .select("id", F.least("id", "m").alias("component"), (F.col("m") < F.col("id")).alias("moved")), "labels",
    )
    while True:
        news = seats.join(label.where("moved").select(F.col("id").alias("u"), "component"), "u")
        told = both.join(news, ["u", "lane"]).select(F.col("v").alias("id"), "component", F.lit(None).cast("long").alias("was"))
        low = materialise(
            told.union(label.select("id", "component", F.col("component").alias("was"))).groupBy("id")
            .agg(F.min("component").alias("component"), F.max("was").alias("was")), "labels")
        heard = low.where("component < was").select(F.col("was").alias("component"), F.col("component").alias("top"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("top")).union(heard).groupBy("component").agg(F.min("top").alias("top"))
        label = materialise(
            spread_join(low, up, ["component"], ["id"])
            .select("id", F.least("component", "top").alias("component"), (F.least("component", "top") < F.col("was")).alias("moved")), "labels")
        if not label.where("moved").limit(1).count():
            return label.select("id", "component")
