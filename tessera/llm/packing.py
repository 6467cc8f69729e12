"""Operator 7, packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids are cut into full pieces of `capacity`, which are sequences of their own and stay where they are, and
one rest. Rests go to groups by a hash of a number of their own, so that no id or text makes a large group; each group
is packed on its own. Only lengths and checksums travel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import documents, gather, materialise, slices

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 2, 4096
#: Documents of a group, on average; encoded words that a worker keeps.
GROUP_DOCUMENTS, KEEP_WORDS = 4096, 400_000
#: Characters of the texts that are encoded together, about, and strings that the tokenizer is given at once.
SLICE_CHARS, RAW = 4_000_000, 1000
#: Marks that the tokenizer sees as a token of their own behind a word; a stretch of letters with one of them or none.
MARKS = ".,!?;:"
SURE = rf"^\pL+[{MARKS}]?$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """A tokenizer that drops white space and never joins across it: the distinct stretches between spaces are encoded
    once a slice of texts, and words are kept for later slices."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        #: Whether the short cuts below are right for this vocabulary: it ends words with </w>, takes no account of case or
        #: of how much white space there is, and its ids fit two bytes. Any other is asked for each text whole.
        self.by_words = len(self.ends) <= 1 << 16 and self.ends.any() and all(
            self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(y, add_special_tokens=False).ids and len(self.tokenizer.encode(y, add_special_tokens=False).ids)
            for x, y in (("Ab  cDe\nf", "ab cde f"), (" ab, cd. ", "ab , cd .")))
        self.marks = self._raw(list(MARKS)) if self.by_words else []

    def _raw(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), RAW):
            out += [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + RAW], add_special_tokens=False)]
        return out

    def _learn_words(self, new: list[str]) -> None:
        """Encode distinct words many at a time: each word's last id is the only one that ends a word."""
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            lines = [part[i : i + 200] for i in range(0, len(part), 200)]
            for line, coded in zip(lines, self._raw([" ".join(x) for x in lines])):
                cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(coded, dtype="<u2")]) + 1) * 2).tolist()]
                if len(cuts) == len(line) + 1 and cuts[-1] == len(coded):
                    self.words.update(zip(line, [coded[lo:hi] for lo, hi in zip(cuts, cuts[1:])]))
                else:
                    self.words.update(zip(line, self._raw(line)))

    def _coded_words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KEEP_WORDS:
            new, self.words = words, {}
        self._learn_words(new)
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        if not self.by_words:
            return [np.array(e.ids, dtype="<u4") for at in range(0, len(texts), RAW)
                    for e in self.tokenizer.encode_batch(texts.slice(at, RAW).to_pylist(), add_special_tokens=False)]
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        places = cut.flatten().dictionary_encode()
        units = places.dictionary
        sure = pc.and_(pc.match_substring_regex(units, SURE), pc.invert(pc.match_substring_regex(units, "[\u03a3\u0130]")))
        known = units.filter(sure)
        mark = pc.index_in(pc.utf8_slice_codeunits(known, -1), pa.array(list(MARKS), known.type))
        low = pc.utf8_lower(pc.utf8_rtrim(known, MARKS)).dictionary_encode()
        rest = units.filter(pc.invert(sure)).to_pylist()
        coded = [*self._coded_words(low.dictionary.to_pylist()), *self._raw(rest), *self.marks, b""]
        pool, size = np.frombuffer(b"".join(coded), dtype="<u2"), np.array([len(c) // 2 for c in coded])
        # the two runs of each unit: a word and its mark, or what is neither and nothing
        none, first_rest = len(coded) - 1, len(low.dictionary)
        runs = np.full((len(units), 2), none)
        is_sure = sure.to_numpy(zero_copy_only=False)
        runs[is_sure, 0] = low.indices.to_numpy(zero_copy_only=False)
        runs[~is_sure, 0] = np.arange(len(rest)) + first_rest
        runs[is_sure, 1] = pc.fill_null(pc.add(mark, first_rest + len(rest)), none).to_numpy(zero_copy_only=False)
        pool, size = gather(pool, size, runs.ravel())
        ids, size = gather(pool, size.reshape(-1, 2).sum(axis=1), places.indices.to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return np.split(ids.astype("<u4"), np.append(0, np.cumsum(size))[ends[:-1]]) if len(ends) else []


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """PIECES of every row: full ones and the rest, which is never empty as END_ID ends each document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_CHARS):
                out = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(path).encode(pc.fill_null(part.column("text"), ""))):
                    ids = np.append(ids, END_ID).astype("<u4")
                    out += [(doc, at, len(x := ids[at : at + capacity]), zlib.crc32(x.tobytes()), len(ids)) for at in range(0, len(ids), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class Tournament:
    """A tree of the room left in bins, each node the most of its two children: first bin with room in log steps."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """Put size into the first bin that has room: (bin, room before)."""
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        bin_no = at - self.width
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_no, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; larger ones first, ties by position."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pack(table: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS, seed: int = 11) -> DataFrame:
    """table (PIECES and each one's number, materialised) with sequence_id and offset. A group's sequences begin at its
    number times 2^32; a full piece's sequence is 2^62 and its number."""
    rests = table.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_documents))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "number"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"], frame["offset"] = (int(frame["g"].iloc[0]) << 32) + bins, offsets
        return frame.drop(columns=["g", "number"])

    keyed = rests.withColumn("g", F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(groups)))
    packed = keyed.groupBy("g").applyInPandas(run, PIECES + ", sequence_id long, offset long")
    full = table.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("number"), "offset": F.lit(0).cast("long")}).drop("number")
    return packed.unionByName(full)


def packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null counts as empty; an empty document is the one id END_ID. Documents of any length are cut, none is shortened.
    Rows repeated with one id, or with none, are each packed, in any group. Ids are cast to long. Columns besides id and
    text are ignored; an empty table gives no rows.
    """
    cut = pieces(df, path or public_tokenizers.path(VOCABULARY), id_col, text_col, capacity)
    return pack(materialise(cut.withColumn("number", F.monotonically_increasing_id()), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(documents(spark, sf_dir))
