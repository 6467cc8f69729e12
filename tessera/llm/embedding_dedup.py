"""Operator 9, embedding near-dedup: a pivot-permutation index.

Pivots are a bounded sample of the vectors that lie apart: a group of near copies has hardly more than one among them,
so its members agree on their nearest pivots whatever share of the rows the group holds. A vector is described by its
PREFIX nearest pivots, nearest first. Every pivot has an inverted list of the vectors that name it. In a list, the
lists of the other pivots are laid over each other to count how many pivots two vectors share; pairs that share SHARED
or more are retrieved, each in the list of one of its common pivots only, and verified in double precision.

Lists above BLOCK vectors are cut into blocks, of which every pair is a group of its own; in a group, counts are kept
for TILE by TILE vectors at a time. Equal vectors are one class throughout. Vectors of other dimensions have pivots and
lists of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, documents, groups, materialise, spread_join

#: Pivots of a dimension at least and at most (between, twice the root of its vectors), pivots of a description, pivots to share.
PIVOTS, PREFIX, SHARED = (96, 16_384), 10, 3
#: Vectors of a block of a list, and of a tile of counts.
BLOCK, TILE = 8192, 2048
#: Cosine from which a sampled pivot is too close to one chosen before, and vectors sampled per pivot.
APART, SAMPLED = 0.8, 4
THRESHOLD = 0.95
POSTING = "dim int, pivot int, id long, size long, near binary, vector binary"
FOUND = "id long, links long, other long"


def classes(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, tag, code) of every row, code null for those that can't link; and (class, code, size, vector) of the distinct
    vectors. A tag is a row's own number, a class the smallest tag of equal vectors."""
    v = F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("tag"), F.col(vector_col).cast(kind).alias("vector"))
    code = F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ",").cast("binary"), 256)
    rows = materialise(rows.withColumn("code", F.when(F.coalesce(usable, F.lit(False)), code)), "vectors")
    heads = materialise(rows.where("code IS NOT NULL").groupBy("code").agg(F.min("tag").alias("class"), F.count(F.lit(1)).alias("size")), "classes")
    one = rows.where("code IS NOT NULL").join(heads.select(F.col("class").alias("tag"), "size"), "tag").select(F.col("tag").alias("class"), "code", "size", "vector")
    return rows.select("id", "tag", "code"), materialise(one, "distinct-vectors")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(distinct: DataFrame, bounds: tuple[int, int] = PIVOTS) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: in the order of their hashes, those of a sample that aren't close to an earlier one.

    The sample is what hashes below a bound that makes it about SAMPLED vectors a pivot, twice that at the most, so the
    driver gets some 2 * SAMPLED * bounds[1] vectors of a dimension whatever the number of rows."""
    spark = distinct.sparkSession
    wanted = {r["dim"]: (int(min(max(bounds[0], 2 * r["n"] ** 0.5), bounds[1])), r["n"]) for r in distinct.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not wanted:
        return {}
    share = spark.createDataFrame([(d, min(1.0, 1.5 * SAMPLED * m / n)) for d, (m, n) in wanted.items()], "dim int, share double")
    place = F.pmod(F.xxhash64("class", F.lit(9)), F.lit(1 << 40))
    rows = distinct.withColumns({"dim": F.size("vector"), "place": place}).join(F.broadcast(share), "dim").where(F.col("place") < F.col("share") * float(1 << 40))
    sample: dict[int, list] = {}
    for r in rows.select("dim", "place", "class", "vector").orderBy("place", "class").toLocalIterator():
        sample.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    for d, vectors in sample.items():
        most = wanted[d][0]
        x, chosen, n = unit(np.array(vectors, dtype=np.float64)), np.empty((most, d)), 0
        for v in x:
            if n < most and (n == 0 or (chosen[:n] @ v).max() < APART):
                chosen[n] = v
                n += 1
        out[d] = chosen[:n]
    return out


def postings(distinct: DataFrame, pivots: dict[int, np.ndarray], prefix: int, shared: int) -> DataFrame:
    """POSTING rows: each vector under each of its nearest pivots, with the ordered description and its own bytes. Where a
    dimension has no more than `shared` pivots, all its vectors share all of them and one list is enough."""
    kind = "<f4" if distinct.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, part in f.groupby(f["vector"].map(len)):
                p = pivots[d]
                k = min(prefix, len(p))
                lists = k if len(p) > shared else 1
                for lo in range(0, len(part), 1000):
                    some = part.iloc[lo : lo + 1000]
                    x = np.array(some["vector"].tolist(), dtype=kind)
                    near = np.argsort(-(unit(x.astype(np.float64)) @ p.T), axis=1, kind="stable")[:, :k].astype("<i2")
                    at = near[:, :lists] if lists == k else np.zeros((len(some), 1), dtype="<i2")
                    yield pd.DataFrame({
                        "dim": d, "pivot": at.ravel().astype(np.int32), "id": np.repeat(some["class"].to_numpy(), lists), "size": np.repeat(some["size"].to_numpy(), lists),
                        "near": np.repeat(np.array([r.tobytes() for r in near], dtype=object), lists), "vector": np.repeat(np.array([r.tobytes() for r in x], dtype=object), lists)})

    return distinct.select("class", "size", "vector").mapInPandas(run, POSTING)


class List:
    """A stretch of one pivot's list: descriptions, unit vectors, and the other pivots' lists over it."""

    def __init__(self, f: pd.DataFrame, dim: int):
        self.ids, self.size = f["id"].to_numpy(), f["size"].to_numpy()
        raw = b"".join(f["vector"])
        self.x = unit(np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dim * len(f) else "<f8").reshape(len(f), dim).astype(np.float64))
        near = np.frombuffer(b"".join(f["near"]), dtype="<i2").reshape(len(f), -1)
        order = np.argsort(near, axis=None, kind="stable")
        member, pivot = order // near.shape[1], near.ravel()[order]
        cut = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
        self.lists = dict(zip(pivot[cut].tolist(), np.split(member, cut[1:])))

    def tiles(self) -> Iterator[tuple[int, int, dict[int, np.ndarray]]]:
        """(from, to, members of each pivot there, counted from `from`)."""
        n = len(self.ids)
        for lo in range(0, n, TILE):
            hi = min(n, lo + TILE)
            cuts = {q: m[slice(*np.searchsorted(m, [lo, hi]))] - lo for q, m in self.lists.items()}
            yield lo, hi, {q: m for q, m in cuts.items() if len(m)}


def retrieved(a: dict[int, np.ndarray], b: dict[int, np.ndarray], na: int, nb: int, own: int, shared: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of two tiles that share `shared` pivots or more, of which `own` is the first by number."""
    count, taken = np.zeros((na, nb), dtype=np.uint8), np.zeros((na, nb), dtype=bool)
    for q in a.keys() & b.keys():
        if q < own:
            if len(a[q]) == na and len(b[q]) == nb:
                return None
            taken[np.ix_(a[q], b[q])] = True
        else:
            count[np.ix_(a[q], b[q])] += 1
    return np.nonzero((count >= shared) & ~taken)


def links_of(left: List, right: List | None, own: int, shared: int, threshold: float) -> pd.DataFrame | None:
    """FOUND rows of one stretch of a list, or of two against each other: weights of the links, and local components."""
    both = left if right is None else right
    shift = 0 if right is None else len(left.ids)
    i, j = [], []
    for lo, hi, a in left.tiles():
        for lo2, hi2, b in both.tiles():
            if right is None and lo2 < lo:
                continue
            if (found := retrieved(a, b, hi - lo, hi2 - lo2, own, shared)) is None:
                continue
            p, q = found
            if right is None and lo == lo2:
                p, q = p[p < q], q[p < q]
            p, q = p + lo, q + lo2
            if len(p) * 8 > (hi - lo) * (hi2 - lo2):  # most of the tile: all its cosines at once
                good = (left.x[lo:hi] @ both.x[lo2:hi2].T)[p - lo, q - lo2] >= threshold
            else:
                good = np.concatenate([np.einsum("ij,ij->i", left.x[p[s : s + 50_000]], both.x[q[s : s + 50_000]]) >= threshold for s in range(0, len(p), 50_000)] or [np.zeros(0, dtype=bool)])
            i.append(p[good])
            j.append(q[good] + shift)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (i, j))
    if not len(i):
        return None
    ids, size = (left.ids, left.size) if right is None else (np.append(left.ids, right.ids), np.append(left.size, right.size))
    links = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
    low = ids.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, i, was[j])
        np.minimum.at(low, j, was[i])
        if (low == was).all():
            break
    at = np.unique(np.concatenate([i, j]))
    return pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "other": low[at]})


def linked(lists: DataFrame, pivots: dict[int, int], shared: int, threshold: float, block: int) -> DataFrame:
    """FOUND rows of all inverted lists; pivots: their number by dimension."""
    size = lists.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("cut", F.ceil(F.col("n") / block).cast("int"))
    rows = lists.join(F.broadcast(size.select("dim", "pivot", "cut")), ["dim", "pivot"])  # at most a row per pivot
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.withColumn("pair", F.explode(pair)).select("dim", "pivot", "pair.i", "pair.j", "own", "id", "size", "near", "vector")
    order = ["dim", "pivot", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, order):
            dim, pivot, i, j = (int(g[c].iloc[0]) for c in order)
            left = g[g["own"] == i]
            right = None if i == j else g[g["own"] == j]
            if len(left) > (right is None) and (right is None or len(right)):
                out = links_of(List(left, dim), None if right is None else List(right, dim), pivot, min(shared, pivots[dim]), threshold)
                if out is not None:
                    yield out

    return rows.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, FOUND)


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD,
                    pivots: tuple[int, int] = PIVOTS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per row of df: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Links join vectors of one dimension with cosine >= threshold that the index finds; none below it. Null or empty
    vectors, zero vectors and those with a null or non-finite component link with nothing. Every row is a vector of its
    own: rows repeated with one id link with each other, and an id that stands for several vectors has a row for each.
    A row with a null id links too, but no component is named after it where another id is in it. Other columns are
    ignored; an empty table gives none.
    """
    rows, distinct = classes(df, id_col, vector_col)
    chosen = choose_pivots(distinct, pivots)
    lists = materialise(postings(distinct, chosen, prefix, shared), "postings")
    found = materialise(linked(lists, {d: len(p) for d, p in chosen.items()}, shared, threshold, block), "links")
    count = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    top = components(found.where("id <> other"), "id", "other").select(F.col("id").alias("class"), "component")
    by_class = distinct.select("class", "code", "size").join(count, "class", "left").join(top, "class", "left")
    by_class = materialise(by_class.select("code", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")), "by-class")
    known = materialise(spread_join(rows, by_class, ["code"], ["tag"], "left"), "by-vector")
    named = known.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    out = spread_join(known, named, ["component"], ["tag"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(documents(spark, sf_dir, "embeddings"))
