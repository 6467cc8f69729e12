"""An inverted file of vectors for approximate nearest neighbours, beside the exact search.

Spark's k-means gives cells; vectors are written in a folder per cell. A search ranks the cells by their centres, reads the
nearest `probes` folders only, and ranks their rows exactly, so with as many probes as cells the answer is the exact one."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knn import knn, knn_join

#: Cells at most, vectors a cell that the centres are fitted on at most, rounds of k-means, rows of a file at most.
MAX_CELLS, SAMPLE_PER_CELL, ROUNDS, FILE_ROWS = 4096, 256, 15, 1_000_000
#: Rows whose neighbours probes_for takes, about, and neighbours that it holds at most.
SAMPLE_QUERIES, SAMPLE_NEIGHBOURS = 256, 200_000
#: The cell of vectors that have no direction or no place (zero, NaN, infinite); it is always read.
ODD = -1


def regular(v: Column) -> Column:
    """Whether k-means can place a vector."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


class IvfIndex:
    """Vectors in cells, in a folder. metric: l2 or cosine."""

    def __init__(self, spark: SparkSession, path: str, *, id: str = "id", vector: str = "embedding", metric: str = "l2"):  # noqa: A002
        self.spark, self.path, self.id, self.vector, self.metric = spark, path.rstrip("/"), id, vector, metric
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
        self.schema = T.StructType.fromJson(json.loads(spark.read.text(f"{self.path}/schema").head()[0]))
        self.cells, self.centres = [r["cell"] for r in rows], np.array([r["centre"] for r in rows], dtype=np.float64)

    @classmethod
    def build(cls, df: DataFrame, path: str, *, cells: int | None = None, id: str = "id", vector: str = "embedding", metric: str = "l2", seed: int = 17) -> IvfIndex:  # noqa: A002
        """Index every row of df with a vector. The centres are fitted on at most about SAMPLE_PER_CELL vectors a cell, drawn by
        a hash of the id; cells: by default the root of the rows, MAX_CELLS at most."""
        if metric not in ("l2", "cosine"):
            raise ValueError(f"no cells for {metric}")
        rows = df.where(F.col(vector).isNotNull())
        good = rows.where(regular(F.col(vector)))
        n = good.count()
        cells = max(1, min(MAX_CELLS, n, cells or round(n**0.5)))
        place = array_to_vector(F.col(vector).cast("array<double>")).alias("v")
        share = min(1.0, SAMPLE_PER_CELL * cells / max(1, n))
        sample = good.where(F.pmod(F.xxhash64(F.col(id), F.lit(3)), F.lit(1 << 20)) < round(share * (1 << 20))).select(place)
        if n:
            means = KMeans(featuresCol="v", predictionCol="cell", k=cells, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(sample)
            placed = means.transform(good.withColumn("v", place)).drop("v").unionByName(rows.where(~regular(F.col(vector))).withColumn("cell", F.lit(ODD)))
            centres = [(i, [float(x) for x in c]) for i, c in enumerate(means.clusterCenters())]
        else:
            placed, centres = rows.withColumn("cell", F.lit(ODD)), []
        placed.hint("rebalance", "cell").sortWithinPartitions("cell", id).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/vectors")
        df.sparkSession.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        df.sparkSession.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
        return cls(df.sparkSession, path, id=id, vector=vector, metric=metric)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def nearest_cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` cells whose centres are nearest to each query, as rows."""
        c, q = self.centres, queries
        if self.metric == "cosine":
            c, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (c, q))
        far = (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T)
        return np.array(self.cells)[np.argsort(far, axis=1, kind="stable")[:, :probes]]

    def probes_for(self, recall: float, k: int) -> int:
        """How many cells a search must read to find `recall` of the k nearest: the exact neighbours of about SAMPLE_QUERIES rows,
        drawn by a hash of the id, are looked up, and how far down each row's list of cells theirs are. The share of cells
        that does depends on how the vectors cluster, and their number on the rows, so neither can be fixed beforehand."""
        rows = self.table().where(F.col("cell") != ODD)
        wanted = max(1, min(SAMPLE_QUERIES, SAMPLE_NEIGHBOURS // k))
        share = min(1.0, wanted / max(1, rows.count()))
        asked = rows.where(F.pmod(F.xxhash64(F.col(self.id), F.lit(5)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(F.col(self.id).alias("query_id"), F.col(self.vector).alias("v"))
        held = asked.withColumn("query_id", F.col("query_id").cast("long")).collect()
        if not held:
            return max(1, len(self.cells))
        order = self.nearest_cells(np.array([r["v"] for r in held], dtype=np.float64), len(self.cells))
        place = {r["query_id"]: {int(c): n for n, c in enumerate(row)} for r, row in zip(held, order)}
        exact = knn_join(asked, rows, k, metric=self.metric, query_vector="v", vector=self.vector, id=self.id)
        near = exact.join(rows.select(F.col(self.id).cast("long").alias("id"), "cell"), "id").select("query_id", "cell").collect()
        depth = sorted(place[r["query_id"]][r["cell"]] for r in near)
        return depth[max(0, math.ceil(recall * len(depth)) - 1)] + 1

    def probed(self, query: list, probes: int) -> DataFrame:
        """The rows of the probed cells and of the odd one: a filter on the folders."""
        if probes < 1:
            raise ValueError("a search reads one cell at least")
        near = self.nearest_cells(np.array([query], dtype=np.float64), probes)[0].tolist() if self.cells else []
        return self.table().where(F.col("cell").isin([*near, ODD])).drop("cell")

    def knn(self, query: list, k: int, probes: int, **kw) -> DataFrame:
        """The k nearest rows in the probed cells, as operators.knn gives them, with its filters."""
        return knn(self.probed(query, probes), query, k, vector=self.vector, id=self.id, metric=self.metric, **kw)

    def knn_join(self, queries: DataFrame, k: int, probes: int, *, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, distance, rank): the k nearest rows for each query within its probed cells. Queries go in blocks; a
        block passes over the cells that any of its queries probes, and a row meets only the queries that probe its cell."""
        if probes < 1:
            raise ValueError("a search reads one cell at least")
        near = lambda q: [{*row, ODD} for row in self.nearest_cells(q, probes).tolist()] if self.cells else [{ODD}] * len(q)
        return knn_join(queries, self.table(), k, metric=self.metric, query_id=query_id, query_vector=vector, vector=self.vector, id=self.id, cells=("cell", near))
