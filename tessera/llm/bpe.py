"""Operator 6, byte-level BPE encoding and decoding by merge replay.

A block of documents (rows of an Arrow batch) is cut into the distinct matches of the tokenizer's pattern. All of them
lie in one flat array of symbols; an inverted index from a pair's rank to its positions is kept, merges are applied
in rank order to all positions at once, and only the pairs next to a merge are looked up again. Documents are then
put together from the results, which a worker keeps (up to a bound) for its later blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, gather, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker keeps for later blocks at most, characters of a piece above which it isn't kept, characters of a block.
KEEP, KEEP_CHARS, BLOCK_CHARS = 300_000, 64, 2_000_000
#: Ids whose bytes are laid out at once for a digest.
STEP = 500_000
#: Texts that cut_texts leaves whole.
ODD = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\x{0}\t\x{b}\x{c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NONE = np.int64(2**62)


class MergeReplay:
    """Merges of a rank table {bytes: rank}. A pair may merge if its bytes together are in the table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: b for b, r in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {
            (ranks[b[:i]] << 32) | ranks[b[i:]]: r
            for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks
        }
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it can't merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty)."""
        ids, size = self.encode_flat(words)
        return np.split(ids, np.cumsum(size)[:-1]) if words else []

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (not empty), end to end, and how many each has."""
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        symbol = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1], before[end - size] = n, -1
        # one slot more than there are symbols: n stands for "no neighbour" to the right, -1 wraps to it on the left
        symbol, after, before = np.append(symbol, -1), np.append(after, n), np.append(before, -1)
        alive = np.ones(n + 1, dtype=bool)
        rank = np.full(n + 1, NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.lookup(symbol[inner], symbol[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for part, k in zip(np.split(at, cuts), r[np.append(0, cuts)].tolist()):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)

        add(inner)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[alive[at] & (rank[at] == r)]
            if len(at) > 1:
                at = np.unique(at)
                left = before[at]
                clash = (rank[left] == r) & (left >= 0)
                if clash.any():  # overlapping pairs, as in "aaa": the leftmost goes first
                    at = self._leftmost(at, before)
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at], after[at] = r, follow
            alive[gone], rank[gone] = False, NONE
            before[follow] = at
            before[n] = -1
            left = before[at]
            left = left[left >= 0]
            has = at[follow < n]
            rank[at] = NONE
            rank[has] = self.lookup(symbol[has], symbol[after[has]])
            rank[left] = self.lookup(symbol[left], symbol[after[left]])
            add(np.concatenate([has, left]))
        kept = np.flatnonzero(alive[:n])
        return symbol[kept], np.diff(np.searchsorted(kept, end), prepend=0)

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by id, end to end, and how many each has; an id without a token has none."""
        each = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        return np.frombuffer(b"".join(each), dtype=np.uint8), np.array([len(b) for b in each])

    @staticmethod
    def _leftmost(at: np.ndarray, before: np.ndarray) -> np.ndarray:
        taken: set[int] = set()
        for i in at.tolist():
            if before[i] not in taken:
                taken.add(i)
        return np.array(sorted(taken), dtype=np.int64)


@lru_cache(maxsize=2)
def replay(path: str) -> MergeReplay:
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of all texts, the order of the texts in which they lie, the number of pieces of each text there).

    A text whose white space is only single spaces and line feeds, each between other characters, is cut where no match
    of the pattern can reach across: before a space, and around a line feed. Any other text is one piece.
    """
    odd = pc.match_substring_regex(texts, ODD)
    marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\0 "), "\n", "\0\n\0")
    cut, is_odd = pc.split_pattern(marked, "\0"), odd.to_numpy(zero_copy_only=False)
    count = np.append(pc.list_value_length(cut).to_numpy(zero_copy_only=False), np.ones(int(is_odd.sum()), dtype=np.int64))
    return pa.concat_arrays([cut.flatten(), texts.filter(odd)]), np.argsort(is_odd, kind="stable"), count


class BlockEncoder:
    """Encodes blocks of texts; results of short pieces are kept for later blocks."""

    def __init__(self, path: str, pattern: str):
        self.model, self.pattern, self.kept = replay(path), regex.compile(pattern), {}
        self.cut = pattern == public_tokenizers.PATTERN  # where else matches end isn't known
        decimals = [b"%d," % i for i in range(max(self.model.tokens) + 1)]
        self.decimals = np.frombuffer(b"".join(decimals), dtype=np.uint8), np.array([len(x) for x in decimals])
        self.bytes = self.model.decoder()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        spans = [self.pattern.findall(p) for p in new]
        number = {w: i for i, w in enumerate(sorted({w for ws in spans for w in ws}))}
        ids, size = self.model.encode_flat([w.encode("utf-8", "surrogatepass") for w in number])
        ids, each = gather(ids, size, np.array([number[w] for ws in spans for w in ws], dtype=np.int64))
        ends = np.append(0, np.cumsum(each))[np.cumsum([len(ws) for ws in spans])] * 4 if new else []
        raw, at, out = ids.astype("<i4").tobytes(), 0, {}
        for p, end in zip(new, map(int, ends)):
            out[p], at = raw[at:end], end
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, the order of the texts in which they lie, the number of ids of each text there); no nulls."""
        pieces, order, count = cut_texts(texts) if self.cut else (texts, np.arange(len(texts)), np.ones(len(texts), dtype=np.int64))
        places = pieces.dictionary_encode()
        distinct = places.dictionary.to_pylist()
        new = self._learn([p for p in distinct if p not in self.kept])
        coded = [self.kept[p] if p in self.kept else new[p] for p in distinct]
        if len(self.kept) + len(new) > KEEP:
            self.kept = {}
        self.kept.update((p, c) for p, c in new.items() if len(p) <= KEEP_CHARS)
        ids, each = gather(np.frombuffer(b"".join(coded), dtype="<i4"), np.array([len(c) // 4 for c in coded], dtype=np.int64),
                           places.indices.to_numpy(zero_copy_only=False))
        return ids, order, np.diff(np.append(0, np.cumsum(each))[np.cumsum(count)], prepend=0)


def digests(pool: tuple[np.ndarray, np.ndarray], ids: np.ndarray, count: np.ndarray, drop: int) -> list[str]:
    """SHA-256 of the pool's bytes of each text's ids, without the last `drop` bytes."""
    ends, hashes = np.append(0, np.cumsum(count)), [hashlib.sha256() for _ in count]
    for lo in range(0, len(ids), STEP):
        raw, each = gather(*pool, ids[lo : lo + STEP])
        hi, at = lo + len(each), np.append(0, np.cumsum(each))
        first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
        start, end = at[np.maximum(ends[first:last], lo) - lo].tolist(), at[np.minimum(ends[first + 1 : last + 1], hi) - lo].tolist()
        for k, i, j in zip(range(first, last), start, end):
            hashes[k].update(raw[i : max(i, j - drop * int(ends[k + 1] <= hi))])
    return [h.hexdigest() for h in hashes]


@lru_cache(maxsize=2)
def block_encoder(path: str, pattern: str) -> BlockEncoder:
    return BlockEncoder(path, pattern)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, pattern: str | None = None,
               with_ids: bool = True) -> DataFrame:
    """One row per row of df: id, n_tokens, ids_sha256 (of decimals joined by commas), decoded_sha256 (of the bytes that
    the ids decode to), and with_ids the ids themselves.

    Null counts as empty: no tokens. Texts of any length are encoded whole; special tokens don't exist. With a pattern of
    one's own, what it doesn't match is left out, and texts aren't cut before it is applied. Repeated rows
    are each encoded; columns besides id and text are ignored. The files are read where the tasks run.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = block_encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, BLOCK_CHARS):
                ids, order, count = coder.encode(pc.fill_null(part.column("text"), ""))
                out = {
                    "id": part.column("id").take(pa.array(order)), "n_tokens": pa.array(count, pa.int64()),
                    "ids_sha256": pa.array(digests(coder.decimals, ids, count, 1)), "decoded_sha256": pa.array(digests(coder.bytes, ids, count, 0)),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, path: str | None = None) -> DataFrame:
    """(id, decoded binary): the bytes of each row's ids in order; null ids give null, an unknown id raises KeyError."""
    path = path or public_tokenizers.path(RANKS)
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = replay(path).tokens
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "decoded": [None if x is None else b"".join([token[int(i)] for i in x]) for x in f["ids"]]})

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), with_ids=False)
