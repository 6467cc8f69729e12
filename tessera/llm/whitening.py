"""Operator 13, whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so that the distinct vectors, their sums and deviations are exact. X, the centred distinct
vectors, is a table; it is multiplied by a vector in blocks of rows, and what comes of it by its transpose, so that a
step is one pass in which Spark adds up a few numbers a task. The driver keeps the right vectors v, and the left vectors
u, as long as the table, by the coefficients z of u = Xz: a task makes those of its rows anew. Both are fully
reorthogonalised twice: v on the driver, u first by the products that are known from Xᵀu, then by those that the pass
measures. The singular values of the small bidiagonal matrix give deviations, its right vectors the components.

A run ends when it has spanned all dimensions, when it can't go on, or when the components asked for have converged;
unless it spanned all, another one orthogonal to what was found looks for equal or larger values that it couldn't see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Residual of a converged value and size of one that counts as none, by the largest value.
CONVERGED, NOTHING = 1e-13, 1e-11
#: Entries from here on, times SCALE, aren't whole numbers of a double any more; their vectors are left out.
LARGEST = float(1 << 52)
WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the vectors that can be used, each entry c as floor(scale * c) + shift."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return df.where(usable).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c) + shift).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy().reshape(-1, dim)


class Centre:
    """The number and exact sums of the fitted vectors, as tasks get them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is taken away before anything is rounded."""
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S)^2) of each row, null where it is beyond a long."""
        about = ((self(x) * self.n) ** 2).sum(axis=1)
        fit, out = about < 2.0**62, np.zeros(len(x), dtype=np.int64)
        out[fit] = (((x[fit] - self.whole) * self.n - self.rest) ** 2).sum(axis=1)
        each: list[int | None] = out.tolist()
        for i in np.flatnonzero(~fit).tolist():
            exact = sum((self.n * a - s) ** 2 for a, s in zip(x[i].tolist(), self.sums))
            each[i] = exact if exact < 1 << 63 else None
        return each


class Fit:
    """The distinct vectors of one dimension, and sums over blocks of their rows."""

    def __init__(self, rows: DataFrame, dim: int, n: int):
        self.rows, self.dim, self.n = rows, dim, n
        low = (1 << 32) - 1
        halves = self._added(lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & low).sum(axis=0)]), "long")
        self.centre = Centre(n, [(halves[i] << 32) + halves[dim + i] for i in range(dim)])

    def _added(self, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in blocks(batches, dim):
                y = of(x)
                total = y if total is None else total + y
            if total is not None:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "value": total})

        got = self.rows.mapInArrow(run, f"i int, value {kind}").groupBy("i").agg(F.sum("value").alias("value")).collect()
        return [r["value"] for r in sorted(got, key=lambda r: r["i"])]

    def added(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of of(X) over blocks X of centred rows; of gives a vector, whose length doesn't grow with the rows."""
        centre = self.centre
        return np.array(self._added(lambda x: of(centre(x)), "double"))


def orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """v without what lies in the span of to's orthonormal columns, taken away twice."""
    for _ in range(2):
        v = v - to @ (to.T @ v)
    return v


def bidiagonalise(fit: Fit, known: np.ndarray, wanted: int, floor: float, largest: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
    """(singular values, right vectors, whether all dimensions are spanned) orthogonal to the columns of known: those that
    have converged. Ends early when `wanted` have, or when the largest is surely below floor; largest is that found before."""
    d = fit.dim
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; Z with U = XZ; XᵀU
    alphas: list[float] = []
    betas: list[float] = []
    v = orthogonal(rng.standard_normal(d), known)
    v = v / np.linalg.norm(v)
    while True:
        right = np.column_stack([right, v])
        c = v.copy()
        for _ in range(2):
            c = c - left @ (back.T @ c)

        def products(x: np.ndarray, c: np.ndarray = c, z: np.ndarray = left) -> np.ndarray:
            u = x @ c
            return np.concatenate([x.T @ u, (x @ z).T @ u, [u @ u]])

        got = fit.added(products)
        measured = got[d:-1]
        c, p, square = c - left @ measured, got[:d] - back @ measured, got[-1] - measured @ measured
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        spanned = right.shape[1] + known.shape[1] == d
        ended = alpha <= NOTHING * largest or not largest
        if not ended:
            alphas.append(alpha)
            left, back = np.column_stack([left, c / alpha]), np.column_stack([back, p / alpha])
            r = orthogonal(p / alpha - alpha * v, np.column_stack([right, known]))
            beta = 0.0 if spanned else float(np.linalg.norm(r))
            ended = beta <= NOTHING * largest
        k = len(alphas)
        small = np.zeros((k, right.shape[1]))
        small[range(k), range(k)] = alphas
        for i in range(min(k, right.shape[1] - 1)):
            small[i, i + 1] = betas[i]
        a, s, b = np.linalg.svd(small, full_matrices=False)
        rest = 0.0 if ended or not k else beta
        good = rest * np.abs(a[-1] if k else np.zeros(0)) <= CONVERGED * (s[0] if k else 1)
        sure = k and wanted == 1 and s[0] * 1.01 + rest * abs(a[-1, 0]) < floor
        if ended or (k >= wanted and good[:wanted].all()) or sure:
            first = int(np.argmin(good)) if not good.all() else len(good)  # what converged from the largest on
            return s[:first], right @ b[:first].T, spanned
        betas.append(beta)
        v = r / beta


def components(fit: Fit, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components as columns) of the largest variances, at most `wanted`, without those that vanish."""
    rng, values, right = np.random.default_rng(seed), np.zeros(0), np.zeros((fit.dim, 0))
    while right.shape[1] < fit.dim:
        floor = np.sort(values)[-wanted] if len(values) >= wanted else 0.0
        s, v, spanned = bidiagonalise(fit, right, wanted if not len(values) else 1, floor, max(values, default=0.0), rng)
        new = not len(s) or s[0] > floor and s[0] > NOTHING * max(values, default=0.0)
        values, right = np.append(values, s), np.column_stack([right, v])
        if spanned or not len(s) or not new:
            break
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > NOTHING * max(values, default=0.0)]
    return values[order] ** 2 / fit.n, right[:, order]


def whitened(fit: Fit, rows: DataFrame, wanted: int) -> DataFrame:
    """(id, WHITENED) of rows (id, x) of one dimension."""
    variance, parts = components(fit, wanted)
    m, scaled = len(variance), parts / np.sqrt(variance)
    trace = float(fit.added(lambda x: np.array([(x * x).sum()]))[0]) / fit.n

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    got = fit.added(moments) / fit.n if m else np.zeros(0)
    mean = got[m * m :]
    error = float(np.abs(got[: m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max()) if m else 0.0
    explained, n = variance / trace if trace else variance, fit.n
    centre = fit.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            each = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(each), n)),
                "deviation": pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)), "whitened": (centre(x) @ scaled).ravel(),
                "explained": np.tile(explained, len(x)), "identity_error": np.full(len(each), error)})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {WHITENED}")


def whitening(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row per vector and component: id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    n counts the distinct vectors of whole numbers, on which all is fitted: means, variances (divisor n), identity_error.
    Left out are vectors that are null or empty, hold null or non-finite entries, or entries beyond 2^52 / scale. A
    component's sign is free but one for all rows. Components without variance have no rows, so one distinct vector alone
    gives none. Vectors of several dimensions are fitted each with those of its dimension. Repeated rows, ids that several
    rows have and null ids each give rows; equal vectors count once in the fit. A deviation beyond a long is null. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = materialise(whole_numbers(df, id_col, vector_col, scale, shift), "whole-numbers")
    distinct = materialise(rows.select("x").distinct(), "fit")
    out = None
    for r in sorted(distinct.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        own = F.size("x") == r["dim"]
        part = whitened(Fit(distinct.where(own), r["dim"], r["n"]), rows.where(own), components)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in WHITENED.split(", ")])
    return out.withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(documents(spark, sf_dir, "embeddings"))
