import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tessera.llm.common import documents
from tests.llm.conftest import SF

TEXTS = ["", None, " ", "a", "aaaaaaaaaaaaa", "  two  spaces ", "line\nbreak\n\nmore\n", "it's we're 'S ’s", "12345 ٣٤ ½", "<|endoftext|> <|startoftext|>x", "日本語 テキスト", "é é İstanbul ΣΑΣ", "tab\tx\r\ny", "!!! ... ??? a.b.c",
         "x" * 5000, "ab" * 3000, " nb em", "a \nb", "😀😀 😀", "MiXeD CaSe, WORDS. end."]


@pytest.fixture(scope="module")
def own():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_check(df, text_of, own):
    rows = df.collect()
    for r in rows:
        ids = own.encode_ordinary(text_of[r.doc_id] or "")
        assert r.n_tokens == len(ids), text_of[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text_of[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256((text_of[r.doc_id] or "").encode()).hexdigest()
    return rows


def test_bpe_matches_the_library(spark, docs, own):
    rows = list(enumerate(TEXTS))
    out = bpe_check(bpe.bpe_encode(docs(rows)), dict(rows), own)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(bpe.bpe_encode(docs(rows))).collect()}
    assert len(out) == len(rows) and all(back[i] == (t or "").encode() for i, t in rows)
    bpe_check(bpe.op6_bpe(spark, SF), {r.doc_id: r.text for r in documents(spark, SF).collect()}, own)


def test_replay_matches_the_library_on_random_words(own):
    rng = random.Random(8)
    model, rule = bpe.replay(P.path(bpe.RANKS)), regex.compile(P.PATTERN)
    words = sorted({w for _ in range(4000) for w in rule.findall("".join(rng.choice("abcdeéßñ tionhesr.,!0129\n ") for _ in range(rng.randint(1, 40))))})
    got = model.encode([w.encode() for w in words])
    assert all(x.tolist() == own.encode_ordinary(w) for w, x in zip(words, got))
    assert model.encode([]) == []


def test_bpe_keeps_within_its_bound(own, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 5)
    coder = bpe.BlockEncoder(P.path(bpe.RANKS), P.PATTERN)
    odd = ["", "  a  b\n\nc", "a\x00b c", "it's a\nb c\xa0d", "a\x1cb c", "a b\n c", "\n", "x y\r\nz", "ab 12 ab3 ,. c", "a b\u2003c", "a b ", ""]
    for texts in (["a b c d e f g", "h"], ["a b z", "x" * 100 + " y"], ["q r s t u v a b"], odd, []):
        ids, order, count = coder.encode(pa.array(texts, pa.string()))
        want = [own.encode_ordinary(texts[i]) for i in order]
        assert sorted(order.tolist()) == list(range(len(texts)))
        assert ids.tolist() == [i for x in want for i in x] and count.tolist() == [len(x) for x in want]
        for step in (1, 3, 1000):
            monkeypatch.setattr(bpe, "STEP", step)
            assert bpe.digests(coder.decimals, ids, count, 1) == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want]
            assert bpe.digests(coder.bytes, ids, count, 0) == [hashlib.sha256(texts[i].encode()).hexdigest() for i in order]


def test_other_patterns_are_applied_to_whole_texts(docs, own):
    texts = [t or "" for t in TEXTS if "\ud800" not in (t or "")]
    for pattern in (r"(?s).{1,7}", r" ?\w+ ?|\S|\s"):
        rows = {r.doc_id: list(r.ids) for r in bpe.bpe_encode(docs(list(enumerate(texts))), pattern=pattern).collect()}
        other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=own._mergeable_ranks, special_tokens={})
        assert rows == {i: other.encode_ordinary(t) for i, t in enumerate(texts)}


def pack_check(rows, text_of, capacity):
    tok = Tokenizer.from_file(P.path(packing.VOCABULARY))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in text_of.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes()), text_of[r.doc_id]
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(by_doc[i]):
            assert s == at
            at += n
        assert at == len(x)
    for x in by_seq.values():
        at = 0
        for s, n in sorted(x):
            assert s == at
            at += n
        assert at <= capacity
    return sum(map(len, ids.values())) / (capacity * len(by_seq))


def test_packing_round_trip(spark, docs):
    rows = list(enumerate(TEXTS))
    pack_check(packing.packing(docs(rows), capacity=64).collect(), dict(rows), 64)
    fill = pack_check(packing.op7_packing(spark, SF).collect(), {r.doc_id: r.text for r in documents(spark, SF).collect()}, 4096)
    assert fill > 0.95


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = (k, 100 - room[k])
        room[k] -= sizes[i]
    assert all(want[i] == (bins[i], offsets[i]) for i in range(300))


def test_edges(awkward, nothing):
    assert bpe.bpe_encode(awkward).count() == 11 and bpe.bpe_encode(nothing).count() == 0
    assert packing.packing(nothing).count() == 0
    rows = packing.packing(awkward).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_word_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "KEEP_WORDS", 3)
    enc, tok = packing.WordEncoder(P.path(packing.VOCABULARY)), Tokenizer.from_file(P.path(packing.VOCABULARY))
    for _ in range(2):
        for t in filter(None, TEXTS):
            assert enc.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t
    odd = ["", "  a  b\n\nc", "Straße. İstanbul ΣΑΣ, σας don't x<|endoftext|>y ½ 漢字。 étude!\tco 12ab, ?!", ".", " \u0301x .a a..b", "Ǆ. ﬁn; 가", "ab?. ,"]
    texts = pa.array(odd + list(filter(None, TEXTS)))
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert enc.encode(pa.array([], pa.string())) == []


def test_many_rows_with_one_id_are_many_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 50)
    df = docs([(7, "one two three")] * 900 + [(None, "w " * 100)] * 300)
    table = packing.materialise(packing.pieces(df, P.path(packing.VOCABULARY), "doc_id", "text", 64).withColumn("number", F.monotonically_increasing_id()), "pieces")
    rows = packing.pack(table, 64, 50).collect()
    assert len(rows) == table.count() == 900 + 300 * 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    groups = {}
    for r in rows:
        if r.length < 64:
            groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 24 and max(groups.values()) < 90
    assert all(r.offset == 0 and r.sequence_id >= 1 << 62 for r in rows if r.length == 64)


def test_another_vocabulary_is_asked_for_whole_texts():
    path = P.path("byte_bpe_50k.json")
    enc, tok = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_words and packing.WordEncoder(P.path(packing.VOCABULARY)).by_words
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
