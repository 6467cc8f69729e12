"""Operator 11, periodic runs of words by enumeration of maximal pairs.

Words become numbers, a document's suffixes are sorted by prefix doubling, and neighbours get their longest common
prefix. The intervals of equal prefixes are visited bottom-up; an interval keeps its suffixes in lists by the word to
their left. Where two children of an interval of prefix length l meet, a suffix of one and a suffix of the other with
another word to its left are a maximal pair: l equal words that can be extended on neither side. With a distance q
between them, the stretch of q + l words from the first on has period q and no neighbour keeps it, so those pairs whose
distance and length satisfy the constraints are the runs; where several have one stretch, its smallest distance is the
period.

Only suffixes that share their first words (as many as the shortest pair has) with another of the document are sorted.
Work is kept small by a property of words that recur at no more than half their length: they lie at equal steps, and all
but the first have one word to their left. So a window has members of two lists at most, that of the nearest suffix and
that of the farthest one, and what is taken from a list of another word is a run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, slices

MIN_WORDS, MIN_TIMES = 24, 3
#: Characters of the texts that are worked on together, about.
BLOCK_CHARS = 4_000_000
RUNS = "runs array<struct<start: long, length: long, period: long>>"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of many texts: their bytes end to end, where each begins, and how many each text has."""

    def __init__(self, texts: pa.Array):
        texts = pc.cast(texts, pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        dark = ~SPACE[raw]
        first = dark.copy()
        first[1:] &= ~dark[:-1]
        inner = ends[:-1][ends[:-1] < len(raw)]
        first[inner] = dark[inner]  # a text begins a word of its own
        at = np.flatnonzero(first)
        self.count = np.diff(np.searchsorted(at, ends), prepend=0)
        self.bytes = raw[dark]
        self.offsets = np.append(np.cumsum(dark)[at] - 1, len(self.bytes)).astype(np.int64)
        self.array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.bytes)])

    def numbers(self) -> np.ndarray:
        return self.array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by a space."""
        size = np.diff(self.offsets)[kept] + 1
        text = np.repeat(np.arange(len(self.count)), self.count)[kept]
        count = np.bincount(text, minlength=len(self.count))
        keep = np.repeat(kept, np.diff(self.offsets))
        where = np.cumsum(size) - size  # of each kept word in the result, while every word has a space behind it
        out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
        inside = np.ones(len(out), dtype=bool)
        inside[where + size - 1] = False
        out[inside] = self.bytes[keep]
        stop = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
        last = (stop[1:] - 1)[count > 0]
        out = np.delete(out, last)
        stop = stop - np.append(0, np.cumsum(count > 0))
        return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(out)])


def repeated(words: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """For each text, whether two of its stretches of `least` words may be equal: their hashes are. None that are is missed."""
    n = len(words)
    if n < least:
        return np.zeros(len(count), dtype=bool)
    text = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        size, out, have, step = least, np.zeros(n - least + 1, dtype=np.uint64), 0, 1
        while True:  # hashes of stretches of 1, 2, 4 ... words make that of `least` words
            if size & step:
                out = out * np.uint64(0xD6E8FEB86659FD93) + h[have : have + len(out)] * np.uint64(2 * step + 1)
                have += step
            if 2 * step > size:
                break
            h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
            h ^= h >> np.uint64(31)
            step *= 2
        inside = text[: len(out)] == text[least - 1 :]
        text = text[: len(out)][inside]
        key = out[inside] + text.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(count), dtype=bool)
    hit[text[order[1:][same]]] = True
    hit[text[order[:-1][same]]] = True
    return hit


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, length of the prefix that each shares with the one before it; 0 for the first)."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    step = 1
    while step < n and int(ranks[-1].max()) < n - 1:
        key = (ranks[-1].astype(np.int64) + 1) << 32
        key[:-step] |= ranks[-1][step:].astype(np.int64) + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        # ranks of 2^k words; a suffix that is shorter ends with what no other has
        fit = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = fit[ranks[k][a[fit]] == ranks[k][b[fit]]]
        for x in (a, b, shared):
            x[same] += 1 << k
        inside = (a < n) & (b < n)
        a[~inside] = b[~inside] = n
    return order, np.append(0, shared)


class Interval:
    """Suffixes of an interval: in order of place, and in lists by the word to their left."""

    __slots__ = ("order", "lists")

    def __init__(self, place: int, left: int):
        self.order, self.lists = [place], {left: [place]}

    def join(self, other: "Interval", length: int, left: list[int], least: int, times: int, found: dict[tuple[int, int], int]) -> "Interval":
        """This interval with another child of the same parent, whose prefix has `length` words; maximal pairs of the two
        that make a run go to found: {(from, to): smallest period}."""
        big, small = (self, other) if len(self.order) >= len(other.order) else (other, self)
        order, widest = big.order, length // (times - 1)
        for x in small.order:
            own = left[x]
            at, lo = bisect_left(order, x), bisect_left(order, x - widest)
            hi = bisect_left(order, x + widest + 1, at)
            for near, far, lowest, highest in ((at - 1, lo, x - widest, x), (at, hi - 1, x, x + widest + 1)):
                if not lo <= near < hi:
                    continue
                for word in {left[order[near]], left[order[far]]}:
                    if word == own:
                        continue
                    places = big.lists[word]
                    for y in places[bisect_left(places, lowest) : bisect_left(places, highest)]:
                        q = abs(x - y)
                        if q + length >= max(least, times * q):
                            span = (min(x, y), max(x, y) + length)
                            found[span] = min(q, found.get(span, q))
        if len(small.order) > 64:
            big.order += small.order
            big.order.sort()
        else:
            for x in small.order:
                insort(order, x)
        for word, places in small.lists.items():
            mine = big.lists.setdefault(word, [])
            if len(places) > 64:
                mine += places
                mine.sort()
            else:
                for x in places:
                    insort(mine, x)
        return big


def maximal_pairs(order: list[int], shared: list[int], left: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """{(from, to): period} of the runs among suffixes of which neighbours share `shared` words (the first entry is not used)."""
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, Interval]] = []
    done = Interval(order[0], left[order[0]])
    for place, length in zip(order[1:], shared[1:]):
        while open_ and open_[-1][0] > length:
            deep, node = open_.pop()
            done = node.join(done, deep, left, least, times, found)
        if open_ and open_[-1][0] == length:
            node = open_.pop()[1]
            done = node.join(done, length, left, least, times, found)
        open_.append((length, done))
        done = Interval(place, left[place])
    while open_:
        deep, node = open_.pop()
        done = node.join(done, deep, left, least, times, found)
    return found


def shortest_pair(least: int, times: int) -> int:
    """The least number of words of a maximal pair that makes a run: a distance q needs max(least, times * q) - q."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def runs_of(words: np.ndarray, count: np.ndarray, least: int = MIN_WORDS, times: int = MIN_TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period; words: numbers of all texts' words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in count]
    short = shortest_pair(least, times)
    hit = np.flatnonzero(repeated(words, count, short))
    if not len(hit):
        return out
    text = np.repeat(np.arange(len(count)), count)
    picked = np.isin(text, hit)
    text, own = text[picked], words[picked]
    order, shared = suffixes(text.astype(np.int64) * (int(words.max()) + 1) + own)
    begin = np.zeros(len(count), dtype=np.int64)
    begin[hit] = np.cumsum(count[hit]) - count[hit]
    left = np.append(-1, own[:-1])
    left[begin[hit]] = -1  # no word of a text's first suffix equals another's
    left = left.tolist()
    cuts = np.flatnonzero(np.append(shared, 0) < short)  # neighbours that share too little end a group
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo > 1:
            part = order[lo:hi].tolist()
            k = int(text[part[0]])
            base = int(begin[k])
            out[k] += [(a - base, b - a, q) for (a, b), q in maximal_pairs(part, shared[lo:hi].tolist(), left, least, times).items()]
    for k in hit.tolist():
        out[k].sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(count: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Whether each word stays: those of a run behind its first period go."""
    change = np.zeros(int(count.sum()) + 1, dtype=np.int64)
    begin = np.cumsum(count) - count
    for k, found in enumerate(runs):
        for start, length, period in found:
            change[begin[k] + start + period] += 1
            change[begin[k] + start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = MIN_WORDS, times: int = MIN_TIMES) -> DataFrame:
    """One row per row of df: id, n_words, runs (start, length, period in words, by start, then period), collapsed (the text
    with single spaces, without the words of any run behind its first period).

    Words are what white space of ASCII parts. A run is at least `least` words and `times` (3 or more) periods long, has
    no smaller period, and no neighbouring word keeps its period. Null counts as empty: no words, no runs, an empty
    collapsed text. Rows are on their own, so repeated ids and null ids get a row each; columns besides id and text
    are ignored; an empty table gives none. A text is worked on whole, in memory of some 30 bytes a character where words
    recur, and in some n log n steps.
    """
    if times < 3 or least < 2:
        raise ValueError("a run has three periods and two words at least")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK_CHARS):
                words = Words(pc.fill_null(part.column("text"), ""))
                runs = runs_of(words.numbers(), words.count, least, times)
                size = np.append(0, np.cumsum([len(x) for x in runs]))
                flat = np.array([r for x in runs for r in x], dtype=np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), each),
                     pc.cast(words.joined(kept_words(words.count, runs)), pa.string())], ["id", "n_words", "runs", "collapsed"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a document for the query: where crc32 of its id is a multiple of 10, the words from some place on repeat
    with a period, both by the hash. Null ids and null texts stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  each value computed once

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n == 0, "").otherwise(bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " ")))

    return F.when(h % 10 == 0, bound(words, repeat)).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of what periodic_runs gives."""
    r = F.col("runs")
    shorter = lambda x, y: x["length"] * y["period"] < y["length"] * x["period"]  # noqa: E731  exact: no quotient is rounded
    best = F.aggregate(r, F.get(r, F.lit(0)), lambda top, x: F.when(shorter(top, x), x).otherwise(top))
    lines = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    top = found.withColumn("best", best)
    return top.select(
        id_col, F.size(r).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size(r) > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return digests(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
