"""Operator 4, n-gram Jaccard join by signature trees.

Texts with the same shingle set are one class. In a signature tree, nodes hold the OR of the token bitmaps of their
texts and their range of set sizes. A dual traversal starts at pairs of nodes and drops those whose sizes or whose
largest possible overlap rule a link out, or whose texts are in one component already; what is left is verified exactly.
Which texts meet in a tree is settled in two steps.

First, classes that agree in a band of minimum hashes are neighbours, and the connected components of neighbours are the
cells, the roots of trees. They bring nearly all links together at little cost: a pair at the threshold shares a band but
for odds of 6e-11 at 0.85 and 5e-8 at 0.8. Large cells are dealt out: random blocks of `block` texts first, which settle
most of the components, then every pair of nodes that still spans two components and passes the bounds, each in a task
of its own.

Then the rest, for certain: with all shingles in one order, rare ones first, two texts of a link have L shingles in common
among the first |x| - ceil(t |x|) + L of each. So every such shingle that texts of different components (of different
cells, where links are counted) have is the root of a tree over those of them that have enough of such shingles; its
pairs that pass the bounds are verified. No pair is left out, whatever the bands do.

Where links are counted, no component is a reason to drop a pair: every pair of classes of a cell that passes the
bounds is verified, and a link counts with the sizes of its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, documents, groups, materialise, release_shuffles, runs, small_batches, spread_join
from tessera.llm.shingles import minhashes, mix, shingle_sets

BANDS, ROWS = 32, 4
WORDS = 32  # 64-bit words of a bitmap
BLOCK, LEAF, ROUNDS = 64, 8, 3
#: Rows of the sample that shows which shingles are common, rows of it that a common one is in, common ones at most. They
#: decide the order of shingles, so the length of lists, and no result.
SAMPLE, COMMON_ROWS, COMMON = 10_000, 3, 200_000
LIST_BLOCK, LEAVES, LEAF_PAIRS = 2048, 64, 2000
SLICE_ROWS, SLICE_CHARS = 500, 1_000_000
SIGNATURE = "id long, n_shingles long, h1 long, h2 long, keys array<long>, first array<long>, bits array<long>"
MEMBER = "cell long, id long, n long, hashes binary, bits array<long>, pop long"
EDGE, FOUND, PAIR = "a long, b long", "id long, links long, other long", "a long, na long, b long, nb long"


def weights(docs: DataFrame) -> list[str]:
    """The column of class sizes, where links are counted."""
    return ["weight"] if "weight" in docs.columns else []


def bitmap(hashes: np.ndarray) -> np.ndarray:
    on = np.zeros(64 * WORDS, dtype=np.uint8)
    on[(hashes & np.uint64(64 * WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(on).view(np.uint64)


def text_slices(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of f (text) in runs of SLICE_ROWS and about SLICE_CHARS characters, one row at least: shingling takes some
    hundred bytes of memory a character of what is shingled together."""
    size = np.array([len(t or "") + SLICE_CHARS // SLICE_ROWS for t in f["text"]], dtype=np.int64)
    run = (np.cumsum(size) - size) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(f)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield f.iloc[lo:hi]


def common_shingles(df: DataFrame, id_col: str, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in several rows of a sample, sorted, and in how many; at most COMMON, so the driver and the tasks
    may hold them."""
    share = SAMPLE / max(1, df.count())
    some = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(4)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))).select(F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in text_slices(f):
                yield pd.DataFrame({"h": np.concatenate([np.empty(0, dtype=np.uint64), *shingle_sets(part["text"].tolist(), n)]).view(np.int64)})

    count = some.mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON_ROWS)
    found = count.orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
    h, c = found["h"].to_numpy(dtype=np.int64).view(np.uint64), found["c"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def first_shingles(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """Of a set (sorted), the first |s| - ceil(t |s|) + L in the order by frequency in the sample, then by value; L is a third
    of what a linked set may lack, and 1. Two linked sets have as many of these in common as the smaller of their Ls."""
    if not len(s):
        return s
    seen = np.zeros(len(s), dtype=np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        seen = np.where(common[0][at] == s, common[1][at], 0)
    lack = len(s) + (-num * len(s)) // den
    return s[np.argsort(seen, kind="stable")[: lack + lack // 3 + 1]]


def signatures(df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """SIGNATURE of every row: the set's size, two sums that stand for it, a key for each band, the first shingles (none
    if empty), and the bitmap."""
    common = common_shingles(df, id_col, text_col, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in text_slices(f):
                sets = shingle_sets(part["text"].tolist(), n)
                low = minhashes(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
                keys = mix((low * np.array([1, 3, 5, 7][:ROWS], dtype=np.uint64)).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
                yield pd.DataFrame({
                    "id": part["id"], "n_shingles": [len(s) for s in sets],
                    "h1": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "h2": [int(mix(s, 99).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                    "keys": [k if len(s) else k[:0] for k, s in zip(keys, sets)],
                    "first": [first_shingles(s, common, num, den).view(np.int64) for s in sets], "bits": [bitmap(s).view(np.int64) for s in sets],
                })

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, SIGNATURE)


def cells(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every text with shingles, and (id, cell, size of the cell) of the classes that have neighbours."""
    key = ["n_shingles", "h1", "h2"]
    some = sig.where("n_shingles > 0 AND id IS NOT NULL")
    heads = materialise(some.groupBy(*key).agg(F.min("id").alias("class")), "classes")
    member = materialise(some.select("id", *key).join(heads, key).select("id", "class").distinct(), "members")
    keys = some.join(member.where("id = class").select("id"), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    first = materialise(keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "first")
    star = materialise(keys.join(first, "key").where("id <> first").select("id", "first").distinct(), "star")
    cell = components(star, "id", "first").withColumnRenamed("component", "cell")
    size = materialise(cell.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), "cell-sizes")
    return member, materialise(cell.join(size, "cell"), "cells")


def members(df: DataFrame, cell: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """MEMBER rows: the shingles and the bitmap of each text that is in a cell."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part in text_slices(f):
                sets = shingle_sets(part["text"].tolist(), n)
                bits = [bitmap(s) for s in sets]
                yield pd.DataFrame({
                    "cell": part["cell"], "id": part["id"], "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets],
                    "bits": [b.view(np.int64) for b in bits], "pop": [int(np.bitwise_count(b).sum()) for b in bits],
                })

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(cell.select("id", "cell"), "id").mapInPandas(run, MEMBER)


class SignatureTree:
    """Nodes over texts sorted by set size, from leaves of LEAF texts to one root; node i's children are 2i and 2i + 1."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.bits, self.pop = n, bits, np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        cut = np.arange(0, len(n), LEAF)
        level = (np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut), np.maximum.reduceat(n - self.pop, cut))
        self.levels = [level]
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), 2)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)


def tree_of(f: pd.DataFrame) -> tuple[pd.DataFrame, SignatureTree]:
    """Texts (id, n, bits, ...) by set size, and the tree over them."""
    f = f.sort_values(["n", "id"], kind="stable").reset_index(drop=True)
    return f, SignatureTree(f["n"].to_numpy(), np.array(f["bits"].tolist(), dtype=np.int64).reshape(len(f), -1).view(np.uint64))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a link may join a text of node i and one of node j: by size, and by the largest possible overlap.
    A text has at most (size - bits) + (bits in common) shingles in common with any text of the other node."""
    lo_a, hi_a, lo_b, hi_b = a[1][i], a[2][i], b[1][j], b[2][j]
    fits = (hi_a * den >= lo_b * num) & (hi_b * den >= lo_a * num)
    common = np.zeros(len(i), dtype=np.int64)
    for lo in range(0, len(i), 50_000):  # a bitmap a pair, so only some at a time
        part = slice(lo, lo + 50_000)
        common[part] = np.bitwise_count(a[0][i[part]] & b[0][j[part]]).sum(axis=1)
    most = np.minimum(np.minimum(a[3][i] + common, hi_a), np.minimum(b[3][j] + common, hi_b))
    return fits & (most * (num + den) >= num * (lo_a + lo_b))


def candidates(a: SignatureTree, b: SignatureTree | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of two trees, or of one with itself: pairs of texts that no bound rules out, those of LEAF_PAIRS pairs of
    leaves at a time, so that memory doesn't grow with the square of a list."""
    other = b or a
    top = max(len(a.levels), len(other.levels)) - 1
    i = j = np.zeros(1, dtype=np.int64)

    def step(i, j, na, nb, wide_a, wide_b):
        def children(x, n, wide):
            c = x[:, None] * wide + np.arange(wide)[None, :] if wide > 1 else x[:, None]
            return c, c < n
        ca, oka = children(i, na, wide_a)
        cb, okb = children(j, nb, wide_b)
        ok = oka[:, :, None] & okb[:, None, :]
        p = np.broadcast_to(ca[:, :, None], ok.shape)[ok]
        q = np.broadcast_to(cb[:, None, :], ok.shape)[ok]
        if b is None:
            keep = p <= q
            p, q = p[keep], q[keep]
        return p, q

    for depth in range(top, -1, -1):
        la, lb = a.levels[min(depth, len(a.levels) - 1)], other.levels[min(depth, len(other.levels) - 1)]
        if depth < top:
            i, j = step(i, j, len(la[0]), len(lb[0]), 2 if depth < len(a.levels) - 1 else 1, 2 if depth < len(other.levels) - 1 else 1)
        ok = possible(la, i, lb, j, num, den)
        i, j = i[ok], j[ok]
    one = lambda t: (t.bits, t.n, t.n, t.n - t.pop)
    for lo in range(0, len(i), LEAF_PAIRS):
        p, q = step(i[lo : lo + LEAF_PAIRS], j[lo : lo + LEAF_PAIRS], len(a.n), len(other.n), LEAF, LEAF)
        if b is None:
            keep = p < q
            p, q = p[keep], q[keep]
        ok = possible(one(a), p, one(other), q, num, den)
        if ok.any():
            yield p[ok], q[ok]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def link(left: pd.DataFrame, right: pd.DataFrame | None, num: int, den: int) -> pd.DataFrame | None:
    """Edges (a, b) that span the components of one node's texts, or of two nodes' against each other.
    Frames have id, n, hashes, bits and a label; texts with one label are taken as connected."""
    left, ta = tree_of(left)
    right, tb = (left, None) if right is None else tree_of(right)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    la, lb, ia, ib, na, nb = (f[c].tolist() for c in ("label", "id", "n") for f in (left, right))
    sa = [np.frombuffer(x, dtype=np.uint64) for x in left["hashes"]]
    sb = sa if tb is None else [np.frombuffer(x, dtype=np.uint64) for x in right["hashes"]]
    out = []
    for i, j in candidates(ta, tb, num, den):
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(la[x]), find(lb[y])
            if p == q or ia[x] == ib[y]:
                continue
            both = overlap(sa[x], sb[y])
            if both * (num + den) >= num * (na[x] + nb[y]):
                root[max(p, q)] = min(p, q)
                out.append((ia[x], ib[y]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else None


def overlaps(sets: list[np.ndarray], n: int | None) -> np.ndarray:
    """Common elements of each two sets, or of each of the first n with each of the others, by stretches of the elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rest = 0 if n is None else n
    out = np.zeros((n or len(sets), len(sets) - rest), dtype=np.int64)
    for lo in range(0, int(column[-1]) + 1, 4096):
        part = slice(*np.searchsorted(column, [lo, lo + 4096]))
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[part], column[part] - lo] = 1
        out += (has[:n] @ has[rest:].T).astype(np.int64)
    return out


def count_links(left: pd.DataFrame, right: pd.DataFrame | None, num: int, den: int) -> pd.DataFrame | None:
    """FOUND rows of one node's texts, or of two nodes' against each other: links by weight, and local components."""
    left, ta = tree_of(left)
    both, tb = left, None
    if right is not None:
        right, tb = tree_of(right)
        both = pd.concat([left, right], ignore_index=True)
    some = list(candidates(ta, tb, num, den))
    if not some:
        return None
    i, j = np.concatenate(some, axis=1)
    common = overlaps([np.frombuffer(x, dtype=np.uint64) for x in both["hashes"]], None if tb is None else len(left))[i, j]
    if tb is not None:
        j = j + len(left)
    ids, n, weight = (both[c].to_numpy() for c in ("id", "n", "weight"))
    keep = (common * (num + den) >= num * (n[i] + n[j])) & (ids[i] != ids[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    links = np.bincount(i, weight[j], len(both)) + np.bincount(j, weight[i], len(both))
    low = ids.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, i, was[j])
        np.minimum.at(low, j, was[i])
        if (low == was).all():
            break
    at = np.unique(np.concatenate([i, j]))
    return pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "other": low[at]})


def within_blocks(docs: DataFrame, size: DataFrame, num: int, den: int, block: int, rounds: int, each=link, out_schema: str = EDGE) -> DataFrame:
    """Edges inside blocks: a small cell is one block, a large one is dealt out at random, `rounds` times anew."""
    cut = F.ceil(F.col("size") / block).cast("int")
    rows = (
        docs.join(size.select("id", "size"), "id")
        .withColumn("r", F.explode(F.when(cut > 1, F.sequence(F.lit(0), F.lit(rounds - 1))).otherwise(F.array(F.lit(0)))))
        .withColumn("b", F.pmod(F.xxhash64("id", "r"), cut).cast("int"))
        .select("cell", "r", "b", "id", "n", "hashes", "bits", F.col("id").alias("label"), *weights(docs))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["cell", "r", "b"]):
            if len(g) > 1 and (out := each(g, None, num, den)) is not None:
                yield out

    key = ["cell", "r", "b"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, out_schema)


def across_nodes(docs: DataFrame, label: DataFrame, size: DataFrame, num: int, den: int, block: int, each=link, out_schema: str = EDGE) -> DataFrame:
    """Edges between texts of large cells that `label` leaves in different components: every pair of nodes that may link.

    A component of `block` texts or more has nodes of its own, the others share nodes by set size."""
    large = materialise(size.where(F.col("size") > block).select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "large")
    rows = docs.join(large, "id")
    per = materialise(rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("m")), "label-sizes")
    rows = rows.join(per, ["cell", "label"])
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("long")
    pure = F.col("m") >= block
    rows = materialise(rows.withColumn("pure", pure).withColumn("of", F.when(pure, F.col("label")).otherwise(bucket)), "node-rows")
    count = materialise(rows.groupBy("cell", "pure", "of").agg(F.count(F.lit(1)).alias("k")), "node-sizes")
    rows = rows.join(count, ["cell", "pure", "of"]).withColumn(
        "node", F.xxhash64("pure", "of", F.pmod(F.xxhash64("id", F.lit(77)), F.ceil(F.col("k") / block).cast("int"))))
    rows = materialise(rows.select("cell", "node", "id", "n", "hashes", "bits", "pop", "label", "pure", *weights(docs)), "node-texts")
    nodes = materialise(rows.groupBy("cell", "node").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pop")).alias("slack"), F.min(F.when(F.col("pure"), F.col("label"))).alias("own"),
        F.array(*[F.bit_or(F.col("bits")[k]) for k in range(WORDS)]).alias("bits")), "nodes")
    a, b = nodes.alias("a"), nodes.alias("b")
    common = F.aggregate(F.zip_with("a.bits", "b.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    most = F.least(F.col("a.slack") + common, F.col("a.hi"), F.col("b.slack") + common, F.col("b.hi"))
    fits = (
        (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") <= F.col("b.node"))
        & (F.col("a.own").isNull() | F.col("b.own").isNull() | (F.col("a.own") != F.col("b.own")))
        & (F.col("a.hi") * den >= F.col("b.lo") * num) & (F.col("b.hi") * den >= F.col("a.lo") * num)
    )
    pairs = materialise(a.join(b, fits).where(most * (num + den) >= num * (F.col("a.lo") + F.col("b.lo"))).select(
        F.col("a.cell").alias("cell"), F.col("a.node").alias("x"), F.col("b.node").alias("y")), "node-pairs")
    texts = rows.select("cell", "node", "id", "n", "hashes", "bits", "label", *weights(docs))
    sides = [texts.join(pairs.withColumnRenamed(end, "node").select("cell", "node", F.col("node" if end == "x" else "x").alias("x"),
                                                                  F.col("node" if end == "y" else "y").alias("y")), ["cell", "node"]) for end in ("x", "y")]
    both = sides[0].union(sides[1].where("x <> y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["cell", "x", "y"]):
            first = g["node"] == g["x"].iloc[0]
            left, right = g[first], None if g["x"].iloc[0] == g["y"].iloc[0] else g[~first]
            if len(left) and (right is None or len(right)) and (out := each(left, right, num, den)) is not None:
                yield out

    key = ["cell", "x", "y"]
    return both.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, out_schema)


def label_apart(left: pd.DataFrame, right: pd.DataFrame | None) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | None]]:
    """Frames to compare, so that every two rows of different labels meet, but not those of the commonest label, which may
    hold nearly all of a list."""
    most = (left if right is None else pd.concat([left, right]))["label"].mode().iloc[0] if len(left) else 0
    of = lambda f: (f[f["label"] == most], f[f["label"] != most])
    many, few = of(left)
    sides = [(few, None), (many, few)] if right is None else [(many, of(right)[1]), (few, right)]
    for a, b in sides:
        if len(a) > (b is None) and (b is None or len(b)):
            yield a, b


def early(n: np.ndarray, pos: np.ndarray, i: np.ndarray, m: np.ndarray, spot: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a list's shingle, at places pos and spot of the texts' orders, may be the first that rows i and j have in common:
    what they have in common then is from there on, and must be enough for a link. One order holds for all texts, so a
    linked pair passes in the list of its first common shingle."""
    least = num * (n[i] + m[j])
    return ((n[i] - pos[i]) * (num + den) >= least) & ((m[j] - spot[j]) * (num + den) >= least)


def leaf_pairs(f: pd.DataFrame, start: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in stretches of f (each a tree of one leaf) that have different labels and pass the bounds."""
    pairs = [np.zeros((2, 0), dtype=np.int64)]
    for k in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(k, 1)
        at = start[size == k][:, None]
        pairs.append(np.stack([(at + i).ravel(), (at + j).ravel()]))
    i, j = np.concatenate(pairs, axis=1)
    n, label, pos = f["n"].to_numpy(), f["label"].to_numpy(), f["pos"].to_numpy()
    ok = (label[i] != label[j]) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num) & early(n, pos, i, n, pos, j, num, den)
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    bits = np.array(f["bits"].tolist(), dtype=np.int64).view(np.uint64)
    one = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1).astype(np.int64))
    ok = np.concatenate([possible(one, i[lo : lo + 50_000], one, j[lo : lo + 50_000], num, den) for lo in range(0, len(i), 50_000)])
    return i[ok], j[ok]


def tree_pairs(g: pd.DataFrame, num: int, den: int) -> Iterator[pd.DataFrame]:
    """PAIR rows of one long list, or of two blocks of it against each other, that pass the bounds."""
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    for left, right in label_apart(g[g["own"] == i], None if i == j else g[g["own"] == j]):
        left, ta = tree_of(left)
        other, tb = (left, None) if right is None else tree_of(right)
        one, two = left["label"].to_numpy(), other["label"].to_numpy()
        (n, pos), (m, spot) = ((f["n"].to_numpy(), f["pos"].to_numpy()) for f in (left, other))
        for x, y in candidates(ta, tb, num, den):
            apart = (one[x] != two[y]) & early(n, pos, x, m, spot, y, num, den)
            yield pair_rows(left, x[apart], other, y[apart])


def pair_rows(left: pd.DataFrame, x: np.ndarray, right: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
    """PAIR rows of rows x of left and rows y of right."""
    a, b = left[["id", "n"]].to_numpy()[x], right[["id", "n"]].to_numpy()[y]
    turn = a[:, 0] > b[:, 0]
    a[turn], b[turn] = b[turn], a[turn].copy()
    return pd.DataFrame({"a": a[:, 0], "na": a[:, 1], "b": b[:, 0], "nb": b[:, 1]})


def missed_pairs(df: DataFrame, sig: DataFrame, member: DataFrame, label: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """PAIR rows: all linked pairs of classes that `label` (id, label; a class without one is its own) holds apart.

    A text with fewer first shingles in common with texts of other labels than any link of its size needs is left out.
    Shingles that the same texts have make one list, that of the first of them in the order; a pair is taken from a list whose
    shingle may be its first common one (see early). Lists of up to LEAVES texts are leaves, of which a task bounds many at
    a time; longer ones are trees, cut into blocks above LIST_BLOCK texts. Only texts of pairs that pass are read again."""
    heads = member.where("id = class").select("id").distinct().join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    first = materialise(sig.where("n_shingles > 0").select("id", F.col("n_shingles").alias("n"), "first").join(heads, "id"), "first-shingles")
    # where an id stands for several texts, a place in the order isn't one text's: then no pair is left out by it
    own_place = not first.groupBy("id").count().where("count > 1").limit(1).count()
    each = F.explode("first").alias("shingle")
    shared = first.select("label", each).groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("shingle")
    release_shuffles(df.sparkSession)
    shared = materialise(shared, "shared-shingles")
    release_shuffles(df.sparkSession)
    placed = first.select("id", "n", F.posexplode("first").alias("pos", "shingle")).withColumn("pos", F.col("pos") if own_place else F.lit(-1))
    rows = materialise(placed.join(shared, "shingle"), "shared")
    release_shuffles(df.sparkSession)
    least = F.expr(f"n - (n - ({num} * n + {den - 1}) div {den})")  # the size of the smallest set that may be linked
    keep = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("has")).withColumn("least", least).where(
        F.expr(f"has >= (least - ({num} * least + {den - 1}) div {den}) div 3 + 1")).select("id", "n")
    each = materialise(rows.join(first.select("id", "n", "label").join(keep, ["id", "n"]), ["id", "n"]), "kept")
    same = ["size", "lo", "hi", "x", "y"]
    lists = each.groupBy("shingle").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("pos", "id").alias("place"),
        F.bit_xor(F.xxhash64("id", "n")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "n", "id")).alias("y"))
    lists = materialise(lists.where("a <> b").groupBy(*same).agg(F.min_by("shingle", F.struct("place", "shingle")).alias("shingle")).select("shingle", "size"), "lists")
    rows = materialise(each.join(lists, "shingle"), "list-rows")
    cut = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    rows = rows.withColumn("cut", cut).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.withColumn("pair", F.explode(pair)).select("shingle", "pair.i", "pair.j", "own", "size", "id", "n", "pos", "label")
    bits = sig.select("id", F.col("n_shingles").alias("n"), "h1", "bits").dropDuplicates(["id", "n", "h1"]).drop("h1")
    rows = rows.join(bits, ["id", "n"])
    key = ["shingle", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames, key, 4096):
            new = np.append(True, (f[key].to_numpy()[1:] != f[key].to_numpy()[:-1]).any(axis=1))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(f)))
            small = size <= LEAVES
            i, j = leaf_pairs(f, start[small], size[small], num, den)
            if len(i):
                yield pair_rows(f, i, f, j)
            for lo, k in zip(start[~small].tolist(), size[~small].tolist()):
                yield from tree_pairs(f.iloc[lo : lo + k], num, den)

    pairs = materialise(rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, PAIR).distinct(), "list-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialise(members(df, ids.withColumn("cell", F.lit(0).cast("long")), id_col, text_col, n).dropDuplicates(["id", "n", "hashes"]), "list-texts")
    side = lambda k: texts.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("hashes").alias(f"h{k}"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = np.array([overlap(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(f["ha"], f["hb"])], dtype=np.int64)
            yield f.loc[both * (num + den) >= num * (f["na"] + f["nb"]), ["a", "na", "b", "nb"]]

    return materialise(pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"]).mapInPandas(verify, PAIR).distinct(), "missed-pairs")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, threshold: tuple[int, int] = (80, 100),
               block: int = BLOCK, rounds: int = ROUNDS, links: bool = False, exact: bool = True) -> DataFrame:
    """One row per row of df: id, n_shingles (distinct n-word shingles), component_id (smallest id reachable by links).

    Two texts link if den * (shingles in common) >= num * (shingles of both together), threshold = (num, den). Words
    are split at ASCII white space with A-Z in lower case; fewer than n words make one shingle. Null and empty texts
    have no shingle and link with nothing. Ids are cast to long; rows with a null id are returned with a null
    component. An id that stands for several texts links as all of them. Other columns are ignored.

    exact: whether the links that no band shows are searched for (see above); without, a pair may be missed with the odds
    given there. block: texts of a block of a cell; a cell of more is cut into blocks and nodes, which changes the cost and no result.

    With links, a fourth column n_links is the number of other rows linked directly, those of equal shingle sets
    included; ids should then be unique. Without, only the links that settle the components are verified.
    """
    with small_batches(df.sparkSession):  # all that Python workers do is written in here
        return _join(df, id_col, text_col, n, threshold, block, rounds, links, exact)


def _join(df: DataFrame, id_col: str, text_col: str, n: int, threshold: tuple[int, int], block: int, rounds: int, links: bool, exact: bool) -> DataFrame:
    num, den = threshold
    release_shuffles(df.sparkSession)
    sig = materialise(signatures(df, id_col, text_col, n, num, den), "signatures")
    member, cell = cells(sig)
    docs = materialise(members(df, cell, id_col, text_col, n).dropDuplicates(["id", "n", "hashes"]), "members")
    if links:
        more = missed_pairs(df, sig, member, cell.select("id", F.col("cell").alias("label")), id_col, text_col, n, num, den) if exact else df.sparkSession.createDataFrame([], PAIR)
        return with_links(sig, member, cell, docs, more, id_col, num, den, block)
    edges = materialise(within_blocks(docs, cell, num, den, block, rounds), "block-edges")
    if cell.where(F.col("size") > block).limit(1).count():
        more = across_nodes(docs, components(edges), cell, num, den, block)
        edges = materialise(edges.union(more), "edges")
    top = components(edges)
    if exact:
        more = missed_pairs(df, sig, member, top.withColumnRenamed("component", "label"), id_col, text_col, n, num, den)
        if more.limit(1).count():
            top = components(edges.union(more.select("a", "b")))
    top = top.withColumnRenamed("id", "class")
    known = materialise(
        spread_join(member, top, ["class"], ["id"], "left").groupBy("id").agg(F.min(F.coalesce("component", "class")).alias("component_id")), "components")
    return sig.select("id", "n_shingles").join(known, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def with_links(sig: DataFrame, member: DataFrame, cell: DataFrame, docs: DataFrame, more: DataFrame, id_col: str, num: int, den: int, block: int) -> DataFrame:
    """The rows of `ngram_join` with n_links: every pair of classes of a cell is met in one task, or a bound drops it; more
    (PAIR) are the links between cells."""
    key = ["n_shingles", "h1", "h2"]
    some = sig.where("n_shingles > 0 AND id IS NOT NULL")
    heads = materialise(some.groupBy(*key).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("weight")), "class-sizes")
    docs = materialise(docs.join(heads.select(F.col("class").alias("id"), F.col("n_shingles").alias("n"), "weight"), ["id", "n"]), "weighted")
    found = within_blocks(docs, cell.where(F.col("size") <= block), num, den, block, 1, count_links, FOUND)
    if cell.where(F.col("size") > block).limit(1).count():
        own = cell.select("id", F.col("id").alias("component"))
        found = found.union(across_nodes(docs, own, cell, num, den, max(block, 2), count_links, FOUND))
    weight = heads.select(F.col("class").alias("id"), F.col("n_shingles").alias("n"), "weight")
    ends = more.select("a", "na", "b", "nb").union(more.select("b", "nb", "a", "na")).toDF("id", "_n", "x", "n")
    between = ends.join(weight.withColumnRenamed("id", "x"), ["x", "n"]).select("id", F.col("weight").alias("links"), F.col("x").alias("other"))
    found = materialise(found.union(between), "links")
    count = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    top = components(found.where("id <> other"), "id", "other").withColumnRenamed("id", "class")
    known = materialise(spread_join(member, top, ["class"], ["id"], "left").groupBy("id").agg(F.min(F.coalesce("component", "class")).alias("component_id")), "components")
    number = materialise(heads.join(count, "class", "left").select(*key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "n-links")
    return sig.select("id", *key).join(number, key, "left").join(known, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of df, with all its columns, of each component of linked texts: that of the smallest id. Rows without words stay.

    Where an id is null or stands for several rows, rows are told apart by numbers of their own, so each is judged by its
    own text; of one id's rows the first written stays, and null ids come last. That takes a written copy of df."""
    if not df.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        gone = ngram_join(df, id_col, text_col, **kw).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"))
        return df.join(materialise(gone, "gone"), F.col(id_col) == F.col("_gone"), "left_anti")
    rows = materialise(df.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("whole")), "tagged")
    label = materialise(ngram_join(rows, "tag", "text", **kw).where("n_shingles > 0").select("tag", "component_id").join(rows.select("tag", "id"), "tag"), "labels")
    first = label.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tag")).alias("first"))
    gone = materialise(spread_join(label, first, ["component_id"], ["tag"]).where("tag <> first.tag").select("tag"), "gone")
    return rows.join(gone, "tag", "left_anti").select(*[F.col("whole")[c].alias(c) for c in df.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), n=4, threshold=(85, 100))


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_ngram_join with n_links."""
    return ngram_join(documents(spark, sf_dir), n=4, threshold=(85, 100), links=True)
