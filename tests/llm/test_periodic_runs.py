import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs as pr
from tessera.llm.common import documents
from tests.llm.conftest import SF


def brute(words, least=24, times=3):
    """All runs, by trying every period from every place."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            lo = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - lo >= max(least, times * q):
                found.setdefault((lo, i + q - lo), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def altered(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def made(rng):
    """Words with runs: random ones, repeated blocks with a break, blocks of blocks."""
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        block = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        if kind < 0.3:
            out += [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]
        elif kind < 0.8:
            out += block * rng.randint(2, 12) + block[: rng.randint(0, len(block))]
        else:
            out += (block * rng.randint(2, 8) + [rng.choice("xyz")]) * rng.randint(1, 6)
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (10, 4), (2, 3)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least)
    texts = [made(rng) for _ in range(400)] + [[], ["a"], ["a"] * 24, ["a"] * 23, ["a", "b"] * 40, list("abcabcabc"), list("ab" * 12), ["w"] * 1000]
    words = pr.Words(pa.array([" ".join(t) for t in texts]))
    got = pr.runs_of(words.numbers(), words.count, least, times)
    assert words.count.tolist() == [len(t) for t in texts]
    for t, x in zip(texts, got):
        assert x == brute(t, least, times), t
    joined = words.joined(pr.kept_words(words.count, got)).to_pylist()
    assert [j.decode() for j in joined] == [collapsed(t, x) for t, x in zip(texts, got)]


def test_suffixes_and_their_shared_words():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (2, 1), (50, 1), (300, 2), (300, 40)):
        w = rng.integers(0, k, n)
        order, shared = pr.suffixes(w)
        want = sorted(range(n), key=lambda i: w[i:].tolist())
        assert order.tolist() == want
        for i in range(1, n):
            a, b = w[want[i - 1] :].tolist(), w[want[i] :].tolist()
            assert shared[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_words_are_what_white_space_parts():
    texts = ["", " \t\n", "one", " a\x0bb\x0cc\r\nd ", "x", "é ü z  ", "\x1c a", None]
    words = pr.Words(pa.array(texts).fill_null("")[1:])  # an array with an offset
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]
    assert words.count.tolist() == [len(w) for w in want] and [w.decode() for w in words.array.to_pylist()] == [w for ws in want for w in ws]
    assert [x.decode() for x in words.joined(np.ones(len(words.array), dtype=bool)).to_pylist()] == [" ".join(w) for w in want]
    assert pr.Words(pa.array([], pa.string())).count.tolist() == []


def contract(doc_id, text):
    words = altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute(words)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_matches_brute_force(spark):
    text_of = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    df = pr.op11_periodic_runs(spark, SF)
    rows = df.collect()
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    assert {tuple(r) for r in rows} == {contract(i, t) for i, t in text_of.items()} and sum(r.n_runs > 0 for r in rows) > 10


def test_edges(awkward, nothing, docs):
    got = pr.digests(pr.periodic_runs(awkward.select("*", pr.planted(F.col("doc_id"), F.col("text")).alias("t")).drop("text").withColumnRenamed("t", "text"))).collect()
    want = [contract(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect() if r.doc_id != 7]
    assert sorted(map(str, (tuple(r) for r in got if r.doc_id != 7))) == sorted(map(str, want)) and len(got) == 11
    assert [(r.n_runs, r.start, r.length, r.period) for r in got if r.doc_id == 7] == [(1, 0, 60_000, 1)]
    assert pr.periodic_runs(nothing).count() == 0
    some = {r.doc_id: r for r in pr.periodic_runs(docs([(1, None), (2, "a b c " * 10)])).collect()}
    assert some[1].n_words == 0 and some[1].runs == [] and some[1].collapsed == "" and some[2].collapsed == "a b c" and some[2].runs[0].period == 3
    with pytest.raises(ValueError):
        pr.periodic_runs(nothing, times=2)


def test_ties_of_the_greatest_exponent(docs):
    text = " ".join(["a b"] * 15 + ["x"] + ["c d e f"] * 15 + ["y"] + ["g h"] * 15)  # 15, 15, 15
    r = pr.digests(pr.periodic_runs(docs([(1, text)]))).collect()[0]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (3, 0, 30, 2, 15000)


def test_work_grows_as_the_text():
    import time

    def seconds(n):
        rng = random.Random(1)
        texts = [" ".join(["w"] * n), " ".join(f"a{i % 50}" for i in range(n)), " ".join(" ".join(map(str, range(16))) + f" {rng.random()}" for _ in range(n // 17))]
        began = time.process_time()
        words = pr.Words(pa.array(texts))
        pr.runs_of(words.numbers(), words.count)
        return time.process_time() - began

    seconds(20_000)
    assert seconds(160_000) < 30 * seconds(20_000)
