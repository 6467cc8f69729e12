import glob
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_records as tr
from tessera.llm.common import documents, new_path
from tests.llm.conftest import SF
from tests.llm.test_tokens_packing import TEXTS


def slow_crc32c(raw):
    c = 0xFFFFFFFF
    for b in raw:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert tr.crc32c([b"123456789"]).tolist() == [0xE3069283]
    assert tr.crc32c([bytes(32), b"\xff" * 32, bytes(range(32))]).tolist() == [0x8A9136AA, 0x62A8AB43, 0x46DD794E]
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(0, 140), 640, 641, 4096, 5000, 63 * 64, 1, 0]]
    assert tr.crc32c(parts).tolist() == [slow_crc32c(p) for p in parts] and tr.crc32c([]).tolist() == []
    assert tr.masked(np.array([0xE3069283], dtype=np.uint32)).tolist() == [((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF]


def expected(rows):
    """{id: (start, n_tokens, crc32)} by the library, with ids in order."""
    tok, at, out = Tokenizer.from_file(P.path(tr.VOCABULARY)), 0, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    return out


def test_query_matches_the_library(spark):
    df = tr.op12_token_records(spark, SF)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in df.dtypes} == {"bigint"}
    want = expected([(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect()])
    assert {r.doc_id: tuple(r)[1:] for r in df.collect()} == want


def test_ids_of_any_text_come_back(spark, docs):
    texts = [*TEXTS, "a <|endoftext|> b<|endoftext|>", " a b\nc <| d", "z" * 300_000]
    rows, uri = [(7 * i - 20, t) for i, t in enumerate(texts)], new_path(spark, "tokens")
    index = tr.write_records(docs(rows).repartition(5), uri)
    got = {r.doc_id: r for r in tr.read_records(index, uri).collect()}
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()} == expected(rows)
    tok = Tokenizer.from_file(P.path(tr.VOCABULARY))
    assert all(tok.decode(got[i].ids[:-1], skip_special_tokens=False) == (t or "") for i, t in rows)
    some = index.where("doc_id % 2 = 0").orderBy(F.rand(3))
    assert {r.doc_id: r.ids for r in tr.read_records(some, uri).collect()} == {i: r.ids for i, r in got.items() if i % 2 == 0}


def test_frames_are_those_of_tfrecord_files(spark, docs):
    uri = new_path(spark, "tokens")
    index = tr.write_records(docs([(5, "hello world"), (None, "x"), (3, None)]).coalesce(1), uri)
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file, []).append((r.offset, r.bytes, r.doc_id))
    seen = []
    for file in sorted(by_file):
        raw = open(f"{uri.removeprefix('file://')}/records/{file}", "rb").read()
        at = 0
        for offset, size, doc in sorted(by_file[file]):
            n, head = struct.unpack_from("<QI", raw, at)
            body, (tail,) = raw[at + 12 : at + 12 + n], struct.unpack_from("<I", raw, at + 12 + n)
            mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
            assert offset == at and size == n + 16 and head == mask(slow_crc32c(raw[at : at + 8])) and tail == mask(slow_crc32c(body))
            seen.append((doc, len(body)))
            at += size
        assert at == len(raw)
        assert [d for d, _ in tr.read_stream(io.BytesIO(raw), file)] == [d for _, _, d in sorted(by_file[file])]
    assert sorted(seen, key=str) == [(3, 14), (5, 18), (None, 16)]


def test_damage_is_found(spark, docs):
    uri = new_path(spark, "tokens")
    index = tr.write_records(docs([(i, f"some words {i}") for i in range(50)]).coalesce(1), uri)
    for path in glob.glob(f"{uri.removeprefix('file://')}/records/*.tokens"):
        raw = bytearray(open(path, "rb").read())
        raw[len(raw) // 2] ^= 1
        open(path, "wb").write(raw)
    with pytest.raises(Exception, match="checksum|differ"):
        tr.read_records(index, uri).collect()
    good = tr.frames([1, 2], [b"\0\0", b"\1\0"], False)
    assert [(d, i.tolist()) for d, i in tr.read_stream(io.BytesIO(b"".join(good)), "f")] == [(1, [0]), (2, [1])]
    with pytest.raises(ValueError, match="cut"):
        list(tr.read_stream(io.BytesIO(b"".join(good)[:-3]), "f"))
    assert [(d, i.tolist()) for d, i in tr.parse(memoryview(b"".join(tr.frames([None], [struct.pack("<I", 70_000)], True))), "f")[0]] == [(None, [70_000])]


def test_edges(spark, awkward, nothing, docs):
    uri = new_path(spark, "tokens")
    rows = tr.read_records(tr.write_records(awkward, uri), uri).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 6, 6, None, 7, 8, 9], key=str)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 0
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None]
    uri = new_path(spark, "tokens")
    assert tr.read_records(tr.write_records(nothing, uri), uri).count() == 0
    uri = new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark joins small tasks
    try:
        many = tr.write_records(docs([(4, "hot one")] * 3000 + [(i, "cold") for i in range(100)]), uri)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many.groupBy("file").count().agg(F.max("count")).first()[0] < 1500 and tr.read_records(many, uri).count() == 3100


def test_other_tokenizers_and_small_caches(monkeypatch):
    monkeypatch.setattr(tr, "KEEP", 3)
    texts = [t or "" for t in TEXTS]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, tok = tr.PieceEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
        assert enc.by_pieces == (name == "byte_bpe_50k.json")
        for _ in range(2):
            assert [np.frombuffer(c, dtype=enc.kind).tolist() for c in enc.encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.encode(pa.array([], pa.string())) == []


def test_starts_ascend_with_the_ids(spark, docs):
    index = tr.write_records(docs([(i, "word " * (i % 50)) for i in range(200)]), new_path(spark, "tokens"))
    rows = index.orderBy("doc_id").collect()
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(200)] and all(r.bytes == 28 + 2 * r.n_tokens for r in rows)
