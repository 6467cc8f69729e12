"""Operator 2, exact dedup: tree merge of sorted digest runs.

Every row becomes an entry (digest, row to keep, number of rows), and every lane holds a run of entries sorted by
digest. Lanes are numbers of some digits to the base FAN_IN. In round k the lanes that differ in digit k only exchange
their runs: an entry goes to the one whose digit k is that of its digest's home lane. The FAN_IN runs that meet in a
lane are merged in sorted order, and equal digests, verified by a second hash and the length, become one entry that
keeps the better row. So the width of a digest shrinks by FAN_IN a round until one lane, its home, has it alone; no lane
ever has more entries than its share of the rows.

The way down runs over the first runs: a digest's winner goes to the lanes that have it (at most one row a lane,
whatever the size of the group), and in a lane to the rows, so a digest that a third of all rows share is spread over
all lanes both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, text_or_empty

#: The characters that are deleted before texts are compared: space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
KEY = ["text_sha256", "check", "chars"]
#: Runs that meet in a lane, lanes at least, and rows of a lane about (lanes grow with the rows).
FAN_IN, MIN_LANES, LANE_ROWS = 4, 64, 100_000
#: What decides between equal texts, in this order: longer originals, rows with an id, smaller ids, earlier rows.
ORDER = ["neg_chars", "no_id", "id", "tag"]


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def lanes_for(rows: int, fan_in: int = FAN_IN, least: int = MIN_LANES, each: int = LANE_ROWS) -> int:
    """A power of fan_in, so that no lane has more than about `each` rows."""
    lanes = 1
    while lanes < least or lanes * each < rows:
        lanes *= fan_in
    return lanes


def digest_rows(rows: DataFrame, lanes: int, more: list[str] | None = None) -> DataFrame:
    """Entries of rows (id, text, tag): KEY, ORDER, size and lane. Equality is verified by three values at every level:
    SHA-256, a second 64-bit hash and the length of the normalised text."""
    return (
        rows.select(*(more or []), "id", "tag", (-F.length("text")).cast("long").alias("neg_chars"), F.col("id").isNull().alias("no_id"), normalised(F.col("text")).alias("norm"))
        .select(
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.xxhash64("norm").alias("check"), F.length("norm").alias("chars"),
            *ORDER, *(more or []), F.lit(1).cast("long").alias("size"), F.pmod(F.xxhash64("tag"), F.lit(lanes)).cast("int").alias("lane"))
    )


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by lane, KEY and ORDER: of each stretch of equal lane and KEY the first, with the sum of sizes.
    One entry is held back from batch to batch, as its equals may go on."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for name in ("lane", *KEY):
            c = batch.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        size = np.add.reduceat(batch.column("size").to_numpy(), first)
        out = batch.take(pa.array(first))
        out = out.set_column(out.schema.get_field_index("size"), "size", pa.array(size, pa.int64()))
        held = out.slice(out.num_rows - 1)
        yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def merged(entries: DataFrame) -> DataFrame:
    """Each lane's runs merged into one: the sort within partitions merges them, spilling where it must."""
    order = ["lane", *KEY, *ORDER]
    return entries.repartition("lane").sortWithinPartitions(*order).select(*entries.columns).mapInArrow(collapse, entries.schema)


def tree_merge(entries: DataFrame, lanes: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The first runs, and the winners by digest: (KEY, keep_id, keep_tag, group_size)."""
    leaf = materialise(merged(entries), "runs")
    home = F.pmod(F.conv(F.substring("text_sha256", 1, 7), 16, 10).cast("long"), F.lit(lanes))
    level, step = leaf, 1
    while step < lanes:
        digit = lambda c, at=step: F.floor(c / at) % fan_in
        there = F.col("lane") + (digit(home) - digit(F.col("lane"))) * step
        level = merged(level.withColumn("lane", there.cast("int")))
        step *= fan_in
    return leaf, level.select(*KEY, F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("size").alias("group_size"))


def decided(rows: DataFrame, lanes: int | None, fan_in: int, more: list[str] | None = None) -> DataFrame:
    """rows (id, text, tag, ...): id, tag, keep_id, group_size, kept, text_sha256, and the columns of more."""
    lanes = lanes or lanes_for(rows.count(), fan_in)
    entries = materialise(digest_rows(rows, lanes, more), "digests")
    leaf, winners = tree_merge(entries.drop(*(more or [])), lanes, fan_in)
    down = materialise(leaf.select(*KEY, "lane").join(materialise(winners, "winners"), KEY), "winners")
    return entries.join(down, [*KEY, "lane"]).select("id", "tag", *(more or []), "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, lanes: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same characters remain after deleting white space (WHITE); null counts as empty,
    so null and blank texts form one group. The longest original text stays, then the smallest id; a null id comes
    after every other, and keep_id is null only where all ids of a group are. Of rows repeated with one id and
    length one is kept. Other columns of the input are ignored; an empty table gives none.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("tag"))
    return decided(rows, lanes, fan_in).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns. Of rows with one id and one text one stays, which of them is open
    where their other columns differ.

    Kept rows are found again by 128 bits of hash over id and text. Rows that agree in it become one on the map side
    already, and the kept ones' hashes are joined where the rows then are, so texts are shuffled once."""
    own = lambda id_, text: {"_k1": F.xxhash64(id_, text), "_k2": F.xxhash64(F.lit(2), text, id_)}
    text = text_or_empty(text_col)
    entries = df.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("tag"))
    found = decided(entries.withColumns(own(F.col("id"), F.col("text"))), None, FAN_IN, ["_k1", "_k2"])
    rows = df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in own(F.col(id_col), text).items()]).dropDuplicates(["_k1", "_k2"])
    return rows.join(found.where("kept").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
