import random

import numpy as np
import pandas as pd
import pytest

from tessera.llm import ngram_join as nj
from tessera.llm.common import components, documents
from tessera.llm.shingles import shingle_sets
from tests.llm.conftest import SF


def sets_of(texts, n):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(ids, texts, n, num, den):
    sets, up = sets_of(texts, n), {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


def family(rng, size, words, edits, vocab):
    base = [rng.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_shingles_match_python_sets():
    texts = ["A b c d e", "a B c d", "one two", "", None, " \t", "x" * 300 + " y z w " + "x" * 300, "é É ß  a\x0bb\x0cc\rd", "a a a a a a a a", "a  b c d e f"]
    for n in (1, 4, 5):
        assert [len(s) for s in shingle_sets(texts, n)] == [len(s) for s in sets_of(texts, n)]
    a, b = shingle_sets(["q w e r t y", "Q W E R T y"], 4)
    assert (a == b).all()


def test_join_matches_brute_force(spark, docs):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    texts = [t for k in range(12) for t in family(rng, rng.choice([1, 2, 5]), rng.choice([3, 5, 20, 60, 200]), 4, vocab)]
    texts += family(rng, 150, 90, 6, vocab) + [None, "", "only", "only", "one two", "ONE  two"]
    ids = rng.sample(range(10_000), len(texts))
    got = nj.ngram_join(docs(list(zip(ids, texts))), n=4, threshold=(85, 100), block=16, rounds=2)
    assert sorted(map(tuple, got.collect())) == brute(ids, texts, 4, 85, 100)


def test_links_match_brute_force(spark, docs):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    texts = family(rng, 60, 90, 4, vocab) + family(rng, 9, 30, 2, vocab) + ["one two three"] * 5 + [None, ""]
    sets = sets_of(texts, 4)
    want = [sum(a != b and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    got = nj.ngram_join(docs(list(enumerate(texts))), n=4, threshold=(85, 100), block=16, links=True).collect()
    assert sum(want) > 500 and sorted((r.doc_id, r.n_links) for r in got) == list(enumerate(want))
    assert sorted(tuple(r)[:3] for r in got) == brute(list(range(len(texts))), texts, 4, 85, 100)


def test_links_that_no_band_shows_are_found(spark, docs, monkeypatch):
    """Bands that never agree, and others that agree seldom: the shared first shingles alone must bring the links."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    texts = [t for k in range(10) for t in family(rng, rng.choice([2, 6, 12]), rng.choice([3, 20, 60, 200]), 3, vocab)]
    texts += [f"{passage} " + " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 40]))) for _ in range(40)] + [passage] * 3
    ids = rng.sample(range(10_000), len(texts))
    sets = sets_of(texts, 4)
    want = sorted((i, sum(a != b and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(sets))) for a, (i, x) in enumerate(zip(ids, sets)))
    monkeypatch.setattr(nj, "LIST_BLOCK", 7)
    monkeypatch.setattr(nj, "BANDS", 1)
    for never in (False, True):
        if never:
            monkeypatch.setattr(nj, "minhashes", lambda sets, k: np.array([random.Random(int(s.sum())).randrange(2**60) for s in sets for _ in range(k)], dtype=np.uint64).reshape(len(sets), k))
        df = docs(list(zip(ids, texts)))
        assert sorted(map(tuple, nj.ngram_join(df, n=4, threshold=(85, 100), block=16).collect())) == brute(ids, texts, 4, 85, 100)
        got = nj.ngram_join(df, n=4, threshold=(85, 100), block=16, links=True).collect()
        assert sorted((r.doc_id, r.n_links) for r in got) == want and sum(x for _, x in want) > 100


def test_linked_sets_share_a_first_shingle():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.permutation(400).astype(np.uint64)
        a = np.sort(pool[: rng.integers(1, 60)])
        b = np.sort(np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], pool[300 : 300 + rng.integers(0, 4)]])))
        common = (np.sort(pool[:100]), rng.integers(3, 9, 100))
        for num in (80, 85):
            if len(b) and 100 * nj.overlap(a, b) >= num * (len(a) + len(b) - nj.overlap(a, b)):
                have = len(set(nj.first_shingles(a, common, num, 100).tolist()) & set(nj.first_shingles(b, common, num, 100).tolist()))
                lack = lambda n: n - -(-num * n // 100)
                assert all(have >= lack(-(-num * len(x) // 100)) // 3 + 1 for x in (a, b))


def test_documents_match_brute_force(spark):
    rows = documents(spark, SF).select("doc_id", "text").collect()
    got = nj.op4_ngram_join(spark, SF)
    assert sorted(map(tuple, got.collect())) == brute([r.doc_id for r in rows], [r.text for r in rows], 4, 85, 100)


@pytest.mark.parametrize("leaf_pairs", [2000, 7])
def test_tree_keeps_every_linked_pair(monkeypatch, leaf_pairs):
    monkeypatch.setattr(nj, "LEAF_PAIRS", leaf_pairs)
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(80)]
    texts = [t for _ in range(15) for t in family(rng, 8, rng.choice([10, 40, 41, 120]), 3, vocab)]
    sets = shingle_sets(texts, 3)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    tree = nj.SignatureTree(np.array([len(s) for s in sets]), np.array([nj.bitmap(s) for s in sets]))
    pairs = {p for x, y in nj.candidates(tree, None, 80, 100) for p in zip(x.tolist(), y.tolist())}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if nj.overlap(sets[a], sets[b]) * 180 >= 80 * (len(sets[a]) + len(sets[b]))}
    assert linked <= pairs and len(pairs) < len(sets) * (len(sets) - 1) / 4
    half = len(sets) // 2
    parts = [nj.SignatureTree(tree.n[s], tree.bits[s]) for s in (slice(0, half), slice(half, None))]
    cross = {(a, b + half) for x, y in nj.candidates(*parts, 80, 100) for a, b in zip(x.tolist(), y.tolist())}
    assert {p for p in linked if p[0] < half <= p[1]} <= cross


def test_edges(awkward, nothing):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_join(awkward).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (7, 1, 7), (None, 1, None)} <= got
    assert nj.ngram_join(awkward).count() == 11 and nj.ngram_join(nothing).count() == 0
    kept = nj.representatives(awkward)
    assert kept.columns == awkward.columns and [r.doc_id for r in kept.collect() if r.doc_id in (5, 6)] == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pd.DataFrame(chain, columns=["a", "b"]))).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
