"""Vector tables on Parquet: a checked schema, partition folders, and versions of which several writers make the next."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import store
from tessera.operators.knn import knn
from tessera.operators.versions import Change, State, Store

MAX_VECTORS, MAX_PARTITION, MAX_METADATA, MAX_AUXILIARY, MAX_DIM = 16, 4, 16, 16, 8192
ELEMENTS = {"float32": T.ArrayType(T.FloatType()), "int8": T.ArrayType(T.ByteType()), "bit": T.ArrayType(T.LongType())}
SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(), "blob": T.BinaryType()}
ALLOWED = {"partition": ("int", "text"), "metadata": ("bool", "int", "float", "text"), "auxiliary": ("text", "int", "float", "blob"), "id": ("int", "text")}


@dataclass(frozen=True)
class VectorTableSpec:
    """Columns of a vector table: vectors {name: (element type, dimension)}, partition keys, metadata (both may filter a
    search) and auxiliary columns (only returned), each {name: type}; the type of the id, and each vector's metric."""

    vectors: dict[str, tuple[str, int]]
    partition: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    auxiliary: dict[str, str] = field(default_factory=dict)
    id: str = "id"
    id_type: str = "int"
    metrics: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, columns, most in (("vector", self.vectors, MAX_VECTORS), ("partition", self.partition, MAX_PARTITION), ("metadata", self.metadata, MAX_METADATA), ("auxiliary", self.auxiliary, MAX_AUXILIARY)):
            if len(columns) > most:
                raise ValueError(f"at most {most} {name} columns")
        if not self.vectors:
            raise ValueError("a vector table needs a vector column")
        for name, (element, dim) in self.vectors.items():
            if element not in ELEMENTS or not 1 <= dim <= MAX_DIM:
                raise ValueError(f"{name}: {element}[{dim}] is no vector type")
            metric = self.metric(name)
            if element == "bit" and self.metrics.get(name) or metric not in ("l2", "l1", "cosine", "hamming"):
                raise ValueError(f"{name}: metric {metric} can't be chosen")
        for role in ("partition", "metadata", "auxiliary"):
            for name, kind in getattr(self, role).items():
                if kind.lower() not in ALLOWED[role]:
                    raise ValueError(f"{name}: {kind} is no type of a {role} column")
        if self.id_type not in ALLOWED["id"]:
            raise ValueError(f"{self.id_type} is no type of an id")
        names = [self.id, *self.vectors, *self.partition, *self.metadata, *self.auxiliary]
        if len(set(names)) < len(names) or {"distance", "k"} & set(names):
            raise ValueError("column names clash")

    def metric(self, name: str) -> str:
        return "hamming" if self.vectors[name][0] == "bit" else self.metrics.get(name, "l2")

    def schema(self) -> T.StructType:
        out = [T.StructField(self.id, SCALARS[self.id_type])]
        out += [T.StructField(n, ELEMENTS[e], metadata={"dim": d}) for n, (e, d) in self.vectors.items()]
        for role in ("partition", "metadata", "auxiliary"):
            out += [T.StructField(n, SCALARS[k.lower()]) for n, k in getattr(self, role).items()]
        return T.StructType(out)


#: Types that a column may have besides its own, as they lose nothing.
NARROWER = {"bigint": ("int", "smallint", "tinyint"), "double": ("float",)}


def checked(df: DataFrame, spec: VectorTableSpec) -> DataFrame:
    """df's columns of the spec. A column that is missing or of another type raises; rows with a wrong dimension, a null vector,
    a null id or null metadata raise when they are read."""
    if missing := [f.name for f in spec.schema() if f.name not in df.columns]:
        raise ValueError(f"no column {missing}")
    for f in spec.schema():
        have, want = df.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
        if have != want and have not in (*NARROWER.get(want, ()), "void"):
            raise ValueError(f"{f.name} is {have}, not {want}")
    for name, (element, dim) in spec.vectors.items():
        size = -(-dim // 64) if element == "bit" else dim
        good = F.coalesce(F.size(name) == size, F.lit(False))
        df = df.withColumn(name, F.when(good, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} must have {dim} dimensions"))))
    for name in (spec.id, *spec.metadata):
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is null"))))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema()])


def appended(table: DataFrame, more: DataFrame, spec: VectorTableSpec) -> DataFrame:
    """table and the checked rows of more."""
    return table.unionByName(checked(more, spec))


class VectorTable:
    """A vector table in a folder: parts, deletions and a log (see versions.py), for any number of writers.

    Rows are in order of their ids in a part, with Parquet's bloom filters on the id, so that a lookup skips most of a
    file. insert adds a part, update a part and a deletion, delete a deletion; compact folds deletions in."""

    def __init__(self, spark: SparkSession, path: str, spec: VectorTableSpec, *, write: dict[str, str] | None = None):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        options = {f"parquet.bloom.filter.enabled#{spec.id}": "true"} | (write or {})
        self.store = Store(spark, path, {"rows": spec.schema()}, id=spec.id, partition=tuple(spec.partition), write=options)

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df.repartitionByRange(*self.spec.partition, self.spec.id).sortWithinPartitions(*self.spec.partition, self.spec.id)

    def scan(self) -> DataFrame:
        return self.store.table("rows")

    def get(self, key) -> DataFrame:
        return self.scan().where(F.col(self.spec.id) == key)

    def count(self) -> int:
        """Rows, of the log alone."""
        return self.store.rows("rows")

    def insert(self, df: DataFrame) -> None:
        """Append; an id that the table or df has already raises, and nothing is stored. Rows are staged once; what other
        writers commit meanwhile is only looked through for the ids."""
        part = self.store.stage("rows", self._ordered(checked(df, self.spec)))
        ids = self.store.staged("rows", part).select(self.spec.id)
        if ids.groupBy(self.spec.id).count().where("count > 1").limit(1).count():
            raise ValueError("an id is given twice")

        def work(state: State) -> Change:
            if ids.join(self.store.placed("rows", state).select(self.spec.id), self.spec.id, "left_semi").limit(1).count():
                raise ValueError("an id is in the table already")
            return Change(add={"rows": [part]}, built_on=["rows"])

        self.store.transact(work)

    def update(self, changes: DataFrame) -> None:
        """Change columns by id (see store.updated); only the rows that change are written."""
        fixed = tuple(self.spec.partition)
        store.updated(self.scan(), changes, self.spec.id, fixed)  # unknown columns raise though no row may change
        self.store.update("rows", changes, lambda rows, new: self._ordered(checked(store.updated(rows, new, self.spec.id, fixed), self.spec)))

    def delete(self, ids: DataFrame) -> None:
        self.store.delete("rows", ids)

    def compact(self, share: float = 0.0, small: int = 0) -> int:
        return self.store.compact("rows", share=share, small=small)

    def knn(self, query: list, k: int, vector: str | None = None, **kw) -> DataFrame:
        vector = vector or next(iter(self.spec.vectors))
        if self.spec.vectors[vector][0] != "bit" and len(query) != self.spec.vectors[vector][1]:
            raise ValueError("vector dimensions differ")
        return knn(self.scan(), query, k, vector=vector, id=self.spec.id, metric=self.spec.metric(vector), auxiliary=tuple(self.spec.auxiliary), **kw)
