"""Operator 12, token ids as length-delimited binary records with an index of offsets.

A record is framed as TFRecord files have it: 8 bytes of length, the masked CRC-32C of those, the payload, its masked
CRC-32C, all little-endian. The payload is HEAD (the document's id; flags) and the ids, of two bytes each where the
vocabulary allows, else of four. Documents are range-partitioned and sorted by id before they are encoded, so a task
writes a stretch of the order, in files of bounded size, through pyarrow.fs.

The index is a Parquet table with a row per record: file, offset, bytes, start (ids of all documents before), n_tokens.
It makes the files valid: a file's name is its attempt's own, and Spark commits index rows of finished tasks only, so what
a lost task wrote is never read. With the index records are read in any order; without it a file is read from its start.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import cut_texts
from tessera.llm.common import documents, gather, new_path, slices

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
HEAD, LENGTH, CHECK = struct.Struct("<qI"), struct.Struct("<Q"), struct.Struct("<I")
NO_ID, WIDE = 1, 2
#: Characters encoded together, about; bytes from which a file is closed; bytes read at once; texts given to the tokenizer at once.
SLICE_CHARS, FILE_BYTES, READ_BYTES, RAW = 4_000_000, 256 << 20, 4 << 20, 1000
#: Pieces that a worker keeps for later slices at most, and characters of a piece above which it isn't kept.
KEEP, KEEP_CHARS = 400_000, 64
#: Behind a run of letters, and behind one of digits, no match of the pattern goes on: the letters and digits of which every
#: Unicode version says the same, before a character of ASCII.
BEHIND = (r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}])([\x{1}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}])", r"([0-9])([\x{1}-\x{2F}\x{3A}-\x{7F}])")
#: Pieces that may be encoded in lines, and lines of a text: no white space but a leading blank, nor characters that may be such.
PLAIN, LINES = r"^ ?[!-~\x{A1}-\x{167F}\x{3001}-\x{D7FF}]+$", 500
#: Bytes of a lane of the checksums, a power of two from 8.
LANE = 64
INDEX = "doc_id long, file string, part long, offset long, bytes long, before long, n_tokens long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=1)
def _tables() -> list[np.ndarray]:
    """For CRC-32C from a register of 0: what each byte value makes when 0 to 7 zero bytes follow."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    out = [c]
    for _ in range(7):
        out.append(out[0][out[-1] & 255] ^ (out[-1] >> 8))
    return out


@lru_cache(maxsize=1)
def _pairs() -> list[np.ndarray]:
    """The same for the four 16-bit values of 8 bytes."""
    t, v = _tables(), np.arange(1 << 16)
    return [t[7 - 2 * i][v & 255] ^ t[6 - 2 * i][v >> 8] for i in range(4)]


@lru_cache(maxsize=64)
def _zeros(size: int) -> list[np.ndarray]:
    """What `size` (a power of two) zero bytes make of a register, by each of its four bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if size == 1:
        image = _tables()[0][bits & 255] ^ (bits >> 8)
    else:
        image = _through(_zeros(size // 2), _through(_zeros(size // 2), bits))
    out = []
    for k in range(4):
        table = np.zeros(256, dtype=np.uint32)
        for b in range(8):
            table[1 << b : 2 << b] = table[: 1 << b] ^ image[8 * k + b]
        out.append(table)
    return out


def _through(tables: list[np.ndarray], c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The CRC-32C of each part, all at once: lanes of LANE bytes go through the tables side by side, and those of a part are
    joined in pairs. Zero bytes before a part don't count, as the register begins at 0; its usual beginning of ones is
    the same as ones over the first four bytes, so shorter parts are done by themselves."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    lanes = np.maximum(-(-size // LANE), 1)
    stop = np.cumsum(lanes) * LANE
    data = np.zeros(int(stop[-1]) if len(parts) else 0, dtype=np.uint8)
    view = memoryview(data)
    for p, end in zip(parts, stop.tolist()):
        view[end - len(p) : end] = p
    long = np.flatnonzero(size >= 4)
    for k in range(4):
        data[(stop - size)[long] + k] ^= 0xFF
    pairs, c = _pairs(), np.zeros(len(data) // LANE, dtype="<u4")
    words = data.view("<u2").reshape(len(c), LANE // 2)
    for at in range(0, LANE // 2, 4):
        low = c.view("<u2").reshape(-1, 2)
        c = pairs[0][words[:, at] ^ low[:, 0]] ^ pairs[1][words[:, at + 1] ^ low[:, 1]] ^ pairs[2][words[:, at + 2]] ^ pairs[3][words[:, at + 3]]
    step = LANE
    while len(lanes) and lanes.max() > 1:
        odd = lanes & 1
        even = np.zeros(int((lanes + odd).sum()), dtype=np.uint32)
        first = np.cumsum(lanes + odd) - lanes
        even[np.repeat(first - (np.cumsum(lanes) - lanes), lanes) + np.arange(len(c))] = c
        c, lanes, step = _through(_zeros(step), even[::2]) ^ even[1::2], (lanes + odd) // 2, 2 * step
    out = c ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size < 4).tolist():
        register = 0xFFFFFFFF
        for b in parts[k]:
            register = int(_tables()[0][(register ^ b) & 255]) ^ (register >> 8)
        out[k] = register ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)


class PieceEncoder:
    """A tokenizer of the tokenizers library. Where it cuts texts as byte-level BPE does and changes nothing before, texts are
    cut at single spaces and line feeds, the distinct pieces of a slice once more behind words and numbers, and what is new
    of that is encoded; the ids of short pieces are kept, end to end, for later slices. Any other tokenizer, and a text with one
    of its special strings or a zero character, is asked for the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; threads for short pieces cost more than they save
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.by_pieces = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.special = [*(t["content"] for t in told["added_tokens"]), "\0"]
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4")
        self.feed = self._raw(["\n"])[0][0] if self.by_pieces else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.size = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), RAW) for e in self.tokenizer.encode_batch_fast(texts[at : at + RAW], add_special_tokens=False)]

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and how many each has. Those without white space but a leading blank are laid LINES to
        a text, with line feeds between, which are an id of their own and in no other."""
        plain = pc.match_substring_regex(pa.array(texts, pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        one, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        lines = ["".join(texts[k] + "\n" for k in one[at : at + LINES]) for at in range(0, len(one), LINES)]
        ids = self._raw([*lines, *(texts[k] for k in rest)])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(size.sum()))
        end = int(size[: len(lines)].sum())
        cut = np.flatnonzero(flat[:end] == self.feed)
        if len(cut) != len(one):
            raise ValueError("the tokenizer joins line feeds with what is beside them")
        own = np.append(np.diff(cut, prepend=-1) - 1, size[len(lines) :])
        flat = np.append(np.delete(flat[:end], cut), flat[end:])
        order = np.argsort(np.array([*one, *rest], dtype=np.int64))
        return gather(flat, own, order)[0], own[order]

    def _coded(self, pieces: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, end to end, and how many each has. What isn't met often isn't kept."""
        if len(self.number) > KEEP:
            self._forget()
        at = np.fromiter(map(self.number.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(at < 0)
        ids, size = self._flat([pieces[k] for k in new.tolist()])
        at[new] = len(self.size) + np.arange(len(new))
        pool, sizes = np.append(self.pool, ids), np.append(self.size, size)
        keep = [k for k in new[often[new]].tolist() if len(pieces[k]) <= KEEP_CHARS]
        some, each = gather(pool, sizes, at[keep])
        self.number.update(zip((pieces[k] for k in keep), range(len(self.size), len(self.size) + len(keep))))
        self.pool, self.size = np.append(self.pool, some), np.append(self.size, each)
        return gather(pool, sizes, at)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls), as bytes."""
        whole = np.full(len(texts), not self.by_pieces)
        for s in self.special if self.by_pieces else []:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(np.flatnonzero(whole).tolist(), self._raw(texts.filter(pa.array(whole)).to_pylist())):
            out[k] = np.array(ids, dtype=self.kind).tobytes()
        rest = np.flatnonzero(~whole)
        pieces, order, count = cut_texts(texts.take(pa.array(rest)))
        places = pieces.dictionary_encode()
        marked = places.dictionary
        for rule in BEHIND:
            marked = pc.replace_substring_regex(marked, rule, "\\1\0\\2")
        parts = pc.split_pattern(marked, "\0")
        small = parts.flatten().dictionary_encode()
        where, part_of, held = (x.to_numpy(zero_copy_only=False) for x in (places.indices, small.indices, pc.list_value_length(parts)))
        times = np.repeat(np.bincount(where, minlength=len(held)), held)
        often = np.bincount(part_of, times, len(small.dictionary)) > 1
        ids, size = gather(*self._coded(small.dictionary.to_pylist(), often), part_of)
        ids, size = gather(ids, np.diff(np.append(0, np.cumsum(size))[np.cumsum(held)], prepend=0), where)
        raw = memoryview(ids.view(np.uint8))
        ends = np.append(0, np.cumsum(size))[np.cumsum(count)] * self.kind.itemsize
        for k, lo, hi in zip(rest[order].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[k] = raw[lo:hi]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def frames(ids: list[int | None], coded: list[bytes], wide: bool) -> list[bytes]:
    """The framed records of documents."""
    flags = WIDE * wide
    bodies = [b"".join((HEAD.pack(i or 0, flags | (NO_ID if i is None else 0)), c)) for i, c in zip(ids, coded)]
    sizes = [LENGTH.pack(len(b)) for b in bodies]
    heads, tails = masked(crc32c(sizes)).tolist(), masked(crc32c(bodies)).tolist()
    return [b"".join((n, CHECK.pack(h), b, CHECK.pack(t))) for n, h, b, t in zip(sizes, heads, bodies, tails)]


def parse(raw: memoryview, where: str) -> tuple[list[tuple[int | None, np.ndarray]], int]:
    """((id, ids as 32-bit numbers) of the whole records at the start of raw, bytes that they take). ValueError where one is damaged."""
    sizes, bodies, told, at = [], [], [], 0
    while at + 12 <= len(raw):
        end = at + 12 + LENGTH.unpack_from(raw, at)[0]
        if end + 4 > len(raw):
            break
        sizes.append(raw[at : at + 8])
        bodies.append(raw[at + 12 : end])
        told.append((CHECK.unpack_from(raw, at + 8)[0], CHECK.unpack_from(raw, end)[0]))
        at = end + 4
    said = np.array(told, dtype=np.uint32).reshape(-1, 2)
    if (masked(crc32c(sizes)) != said[:, 0]).any() or (masked(crc32c(bodies)) != said[:, 1]).any():
        raise ValueError(f"{where}: a record differs from its checksum")
    out = []
    for b in bodies:
        doc, flags = HEAD.unpack_from(b)
        out.append((None if flags & NO_ID else doc, np.frombuffer(b, dtype="<u4" if flags & WIDE else "<u2", offset=HEAD.size).astype("<u4")))
    return out, at


def read_stream(stream, where: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of each record of an open file, without the index."""
    rest = b""
    while True:
        more = stream.read(READ_BYTES)
        rest += more
        found, used = parse(memoryview(rest), where)
        yield from found
        rest = rest[used:]
        if not more:
            if rest:
                raise ValueError(f"{where}: the last record is cut")
            return


def write_records(df: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write a record per row of df, in ascending order of ids, as files under uri/records; the index, which is kept at uri/index.

    Null text counts as empty: the record holds end_id alone. Texts are encoded whole. Rows with one id, whatever share
    of all, are dealt to several tasks; those with none come last. Ids are cast to long; other columns are ignored. An
    empty table makes an empty index and no file."""
    spark, path, end = df.sparkSession, path or public_tokenizers.path(VOCABULARY), end_id
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tag"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tag")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), coder, part, out, before = fs.FileSystem.from_uri(f"{uri}/records"), encoder(path), TaskContext.get().partitionId() << 32, None, 0
        wide = coder.kind.itemsize == 4
        tail = np.array([end], dtype=coder.kind).tobytes()
        try:
            for batch in batches:
                for some in slices(batch, SLICE_CHARS):
                    if out is None:
                        name, offset = f"{part >> 32:06d}-{part & 0xFFFFFFFF:04d}-{uuid.uuid4().hex}.tokens", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                    coded = [b"".join((c, tail)) for c in coder.encode(pc.fill_null(some.column("text"), ""))]
                    framed = frames(some.column("doc_id").to_pylist(), coded, wide)
                    out.write(b"".join(framed))
                    size = np.array([len(f) for f in framed], dtype=np.int64)
                    count = np.array([len(c) for c in coded], dtype=np.int64) // len(tail)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": some.column("doc_id"), "file": [name] * len(size), "part": np.full(len(size), part), "offset": offset + np.cumsum(size) - size,
                        "bytes": size, "before": before + np.cumsum(count) - count, "n_tokens": count})
                    offset, before = offset + int(size.sum()), before + int(count.sum())
                    if offset >= FILE_BYTES:
                        out.close()
                        out, part, before = None, part + 1, 0
        finally:
            if out is not None:
                out.close()

    found = new_path(spark, "token-records")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tag").mapInArrow(run, INDEX).write.parquet(found)
    found = spark.read.parquet(found)
    files = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))  # a row per file
    base = files.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found.join(base, "file").select("doc_id", "file", "part", "offset", "bytes", (F.col("base") + F.col("before")).alias("start"), "n_tokens").write.parquet(f"{uri}/index")
    return spark.read.parquet(f"{uri}/index")


def read_records(index: DataFrame, uri: str, *, with_ids: bool = True) -> DataFrame:
    """RECORD rows of the records that index names (all, or any of its rows), and with_ids the ids; read where they lie, some
    neighbours at once. A ValueError is raised where a record is damaged or isn't the one that the index tells of."""
    files = max(1, index.select("file").distinct().count())
    rows = index.select("file", "offset", "bytes", "doc_id", "start", "n_tokens").repartition(files, "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{uri}/records")
        at_hand, stream = None, None
        try:
            for batch in batches:
                file, offset, size, doc_id, start, count = (batch.column(c).to_pylist() for c in batch.schema.names)
                lo = 0
                while lo < len(file):
                    hi = lo + 1
                    while hi < len(file) and file[hi] == file[lo] and offset[hi] == offset[hi - 1] + size[hi - 1] and offset[hi] + size[hi] - offset[lo] <= READ_BYTES:
                        hi += 1
                    if file[lo] != at_hand:
                        if stream is not None:
                            stream.close()
                        at_hand, stream = file[lo], store.open_input_file(f"{root}/{file[lo]}")
                    stream.seek(offset[lo])
                    found, used = parse(memoryview(stream.read(offset[hi - 1] + size[hi - 1] - offset[lo])), at_hand)
                    if [d for d, _ in found] != doc_id[lo:hi] or [len(i) for _, i in found] != count[lo:hi]:
                        raise ValueError(f"{at_hand}: records differ from the index")
                    out = {"doc_id": pa.array(doc_id[lo:hi], pa.int64()), "start": start[lo:hi], "n_tokens": count[lo:hi], "ids_crc32": [zlib.crc32(i) for _, i in found]}
                    if with_ids:
                        out["ids"] = pa.array([i.astype(np.int32) for _, i in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)
                    lo = hi
        finally:
            if stream is not None:
                stream.close()

    return rows.mapInArrow(run, RECORD + ", ids array<int>" * with_ids)


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "tokens")
    return read_records(write_records(documents(spark, sf_dir), uri), uri, with_ids=False)
