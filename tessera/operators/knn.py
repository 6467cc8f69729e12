"""Exact nearest neighbours: filters first, then distance, then top-k. No index, so no answer is approximate.

A single query is a literal: Spark keeps the k best of each partition and merges them. Batches of queries go through
the corpus in blocks, with numpy's matrix product on Arrow batches, which only chooses what is then measured; each task keeps its own k best of every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as vec
from tessera.operators.shared import new_path

MAX_K = 4096
OPERATORS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__, "!=": Column.__ne__}
#: Ids of an `ids` filter that are sent as a literal list at most; more come as a DataFrame.
LITERAL_IDS = 10_000
#: The rounding of a double.
EPSILON = 2.0**-52
#: Bytes of the query vectors of one pass over the corpus, which every task is sent, and neighbours that a task keeps for them.
QUERY_BYTES, QUERY_KEPT = 64 << 20, 4_000_000


def _check(df: DataFrame, query: list | None, k: int, vector: str, metric: str) -> None:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k must be from 0 to {MAX_K}, not {k}")
    kind = vec.element_type(df.schema[vector].dataType.simpleString())
    if (metric == "hamming") != (kind == "bit"):
        raise ValueError(f"{metric} distance is not for {kind} vectors")
    if metric not in vec.DISTANCES:
        raise ValueError(f"unknown metric {metric}")
    if query is not None and not len(query):
        raise ValueError("the query vector is empty")


def literal(query: list, kind: str) -> Column:
    return F.array(*[F.lit(x) for x in query]).cast(kind)


def constrained(column: Column, constraint: tuple) -> Column:
    """A comparison (operator, value) on a column; ('in', values) for membership."""
    op, value = constraint
    if op == "in":
        return column.isin(list(value))
    if op not in OPERATORS:
        raise ValueError(f"no filter by {op}")
    return OPERATORS[op](column, F.lit(value))


def constraints(where) -> list[tuple[str, tuple]]:
    """Filters as (column, (operator, value)), of a dict {column: (operator, value)} or a list of (column, operator, value)."""
    return list(where.items()) if isinstance(where, dict) else [(name, (op, value)) for name, op, value in where or []]


def filtered(df: DataFrame, where, ids, id_col: str, auxiliary: tuple[str, ...] = ()) -> DataFrame:
    """df under metadata and partition filters (see constraints) and an id filter (list or DataFrame of ids)."""
    for name, constraint in constraints(where):
        kind = df.schema[name].dataType.simpleString()
        if name in auxiliary:
            raise ValueError(f"{name} is auxiliary: it can't filter a nearest-neighbour query")
        if kind == "boolean" and constraint[0] not in ("=", "!="):
            raise ValueError(f"a boolean takes = and != only, not {constraint[0]}")
        if constraint[0] == "in" and kind in ("float", "double", "boolean"):
            raise ValueError(f"no membership filter on {kind}")
        if isinstance(constraint[1], DataFrame):  # membership in what a query gives: a join, by which Spark prunes partitions at run time
            if constraint[0] != "in":
                raise ValueError(f"a DataFrame of values takes in only, not {constraint[0]}")
            values = constraint[1].select(F.col(constraint[1].columns[0]).cast(kind).alias(name))
            df = df.join(values, name, "left_semi").select(*df.columns)
        else:
            df = df.where(constrained(F.col(name), constraint))
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    ids = list(ids)
    if len(ids) > LITERAL_IDS:
        raise ValueError(f"more than {LITERAL_IDS} ids: give them as a DataFrame")
    return df.where(F.col(id_col).isin(ids))


def knn(df: DataFrame, query: list, k: int, *, vector: str = "embedding", id: str = "id", metric: str = "l2", where=None,  # noqa: A002
        ids=None, distance: tuple[str, float] | None = None, per: str | None = None, auxiliary: tuple[str, ...] = (), with_vector: bool = False) -> DataFrame:
    """The k rows nearest to query, by distance, then id: df's columns, and distance; the vector only with_vector.

    where: {column: (operator, value)} or a list of (column, operator, value), which may name a column twice; ids: a list or
    DataFrame (so may the values of "in" be); distance: (operator, value), applied before the k are taken; per: a column, for the k nearest of each of its
    values. Null vectors are left out; NaN distances come last. Only ids and distances are ranked: the vectors of the k
    follow by their ids, which must then be unique.
    """
    _check(df, query, k, vector, metric)
    kind = df.schema[vector].dataType.simpleString()
    rows = filtered(df, where, ids, id, auxiliary).where(F.col(vector).isNotNull())
    rows = rows.withColumn("distance", vec.DISTANCES[metric](F.col(vector), literal(query, kind))).drop(vector)
    if distance is not None:
        if distance[0] not in (">", ">=", "<", "<="):
            raise ValueError(f"no distance filter by {distance[0]}")
        rows = rows.where(constrained(F.col("distance"), distance))
    if per is None:
        near = rows.orderBy("distance", id).limit(k)
    else:
        rank = F.row_number().over(Window.partitionBy(per).orderBy("distance", id))
        near = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.join(df.select(id, vector), id) if with_vector else near


def _bounds(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each query to each row by matrix products (squared for l2), and for each query by how much one may be off."""
    if metric == "l1":
        near = np.stack([np.abs(x - one).sum(axis=1) for one in q])
        return near, np.zeros(len(q))
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            near = 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
        return near, np.full(len(q), 4 * (x.shape[1] + 4) * EPSILON)
    # distances don't change with the origin: near the rows' mean, less is lost by cancellation
    with np.errstate(invalid="ignore", over="ignore"):
        middle = x.mean(axis=0)
        middle[~np.isfinite(middle)] = 0
        x, q = x - middle, q - middle
        xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
        near = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
        top = xx[np.isfinite(xx)].max(initial=0.0)
        return near, 2 * (x.shape[1] + 8) * EPSILON * (np.sqrt(qq) + np.sqrt(top)) ** 2


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a query to a few rows, row by row, so that a row's doesn't depend on those beside it."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if metric == "l1":
            return np.abs(x - q).sum(axis=1)
        if metric == "l2":
            return np.sqrt(((x - q) ** 2).sum(axis=1))
        return 1 - (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class _Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q)

    def offer(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """Rows that the queries named by number may have."""
        k = self.k
        for lo in range(0, len(queries), 256):
            some = queries[lo : lo + 256]
            near, off = _bounds(self.q[some], x, self.metric)
            near[np.isnan(near)] = np.inf
            for at, row, slack in zip(some.tolist(), near, off.tolist()):
                pick = np.arange(len(row))
                if len(row) > k:  # the k best are among those that rounding may have put behind the k-th
                    edge = np.partition(row, k - 1)[k - 1] + (2 * slack if slack == slack else np.inf)
                    pick = np.flatnonzero(row <= edge) if edge == edge else pick
                d, i = _exact(self.q[at], x[pick], self.metric), ids[pick]
                if self.found[at] is not None:
                    d, i = np.concatenate([self.found[at][0], d]), np.concatenate([self.found[at][1], i])
                order = np.lexsort((i, d))[:k]
                self.found[at] = d[order], i[order]


def _one_pass(corpus: DataFrame, block: pd.DataFrame, k: int, metric: str, vector: str, id_col: str, cells=None) -> DataFrame:
    names, q = block["query_id"].to_numpy(), np.array(block["vector"].tolist(), dtype=np.float64)
    probed = cells[1](q) if cells else None
    who = {c: np.array([n for n, p in enumerate(probed) if c in p]) for c in set().union(*probed)} if cells else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(q, k, metric)
        for f in frames:
            if not len(f):
                continue
            for cell, part in f.groupby("cell", sort=False) if who is not None else [(None, f)]:
                x = np.array(part["vector"].tolist(), dtype=np.float64).reshape(len(part), -1)
                if x.shape[1] != q.shape[1]:
                    raise ValueError("vector dimensions differ")
                best.offer(x, part["id"].to_numpy(), np.arange(len(q)) if who is None else who[cell])
        for name, found in zip(names, best.found):
            if found is not None:
                yield pd.DataFrame({"query_id": name, "id": found[1], "distance": found[0]})

    rows = corpus.where(F.col(cells[0]).isin([int(c) for c in who])).withColumnRenamed(cells[0], "cell") if cells else corpus.withColumn("cell", F.lit(0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), "cell").where("vector IS NOT NULL")
    found = rows.mapInPandas(run, "query_id long, id long, distance double")
    return found.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # pandas gives NaN as null


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, *, metric: str = "l2", query_id: str = "query_id", vector: str = "embedding", id: str = "id",  # noqa: A002
             query_vector: str | None = None, cells=None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of corpus for each query, by distance, then id; NaN distances last.

    Matrix products only choose rows that may be among the k; what is ranked are exact distances, so the answer doesn't depend
    on how large the vectors are nor on how they are dealt out.

    Queries are taken in blocks, in order of their ids: as many as QUERY_BYTES of vectors and QUERY_KEPT neighbours
    allow. Each block passes over the corpus once and its neighbours are written before the next, so the driver holds one
    block, and a task one block and its neighbours, whatever the number of queries.

    cells: (a column of corpus, a function from an array of queries to the set of its values that each query is to meet)."""
    if not 1 <= k <= MAX_K or metric not in ("l2", "l1", "cosine"):
        raise ValueError("k must be from 1 to 4096, and the metric l2, l1 or cosine")
    from tessera.operators.numbering import numbered

    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector or vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).head()
    if not size["n"]:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    block = max(1, min(QUERY_BYTES // (8 * max(1, size["d"])), QUERY_KEPT // k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = lambda held: _one_pass(corpus, held, k, metric, vector, id, cells).withColumn("rank", rank).where(F.col("rank") <= k)
    if size["n"] <= block:
        return best(asked.toPandas())
    spark, path = corpus.sparkSession, new_path(corpus.sparkSession, "knn-join")
    rows = numbered(asked, [F.col("query_id")], "at", start=0)
    for lo in range(0, size["n"], block):
        best(rows.where(F.col("at").between(lo, lo + block - 1)).drop("at").toPandas()).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def static_vectors(df: DataFrame, name: str) -> DataFrame:
    """Register a fixed set of vectors under a name, kept in memory, for knn over spark.table(name). The frame returned is
    what was cached: unpersist it when the set is no longer needed."""
    out = df.cache()
    out.createOrReplaceTempView(name)
    return out
