"""Ingest: files, folders, chat exports and snippets become rows for the store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

LINES = 10


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under a folder, or of one file. Files that are too large or empty are left
    out by their listed length, before they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under a folder, or of one file; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def with_content(files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, each read by the task that has its row; content is null where that fails."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, length in zip(f["path"], f["length"]):
                try:
                    store, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    with store.open_input_stream(where) as source:
                        content = source.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "length": [length], "content": [content]})

    return files.select("path", "length").mapInPandas(run, "path string, length long, content binary")


def mined(path: Column, length: Column, root: str | None = None, ignore: list[str] | None = None) -> Column:
    return ~text.should_skip(text.basename(path)) & text.size_fits(length) & ~text.ignored(relative(path, root), ignore or [])


def relative(path: Column, root: str | None) -> Column:
    """path from root on, as it is without one. Readers put a scheme before absolute paths, so root is looked for inside."""
    if root is None:
        return path
    root = root.rstrip("/") + "/"
    at = F.locate(root, path)
    return F.when(at > 0, F.substring(path, at + len(root), F.length(path))).otherwise(path)


def file_chunks(files: DataFrame, root: str | None, max_chunk: int = text.MAX_CHUNK, overlap: int = text.OVERLAP, every: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """(room, source_path, source_type, chunk_index, start, end, content) of the files that aren't skipped (every: of all that
    fit). In a folder a room is the base name of the root; a file that comes alone is its own room.
    Bytes that are no UTF-8 are replaced."""
    keep = text.size_fits(F.col("length")) if every else mined(F.col("path"), F.col("length"), root, ignore)
    room = F.lit(root.rstrip("/").rpartition("/")[2]) if root else text.basename(F.col("path"))
    rows = files.where(keep).select(room.alias("room"), relative(F.col("path"), root).alias("source_path"), F.lit("file").alias("source_type"),
                                    F.col("content").cast("string").alias("content"))
    return text.chunked(rows, "content", max_chunk, overlap).where(F.octet_length("content") > 0)


def stats(files: DataFrame, root: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(files_processed, files_skipped, bytes, errors) in one aggregate. A file that is to be mined but whose content is null,
    as could not be read, is an error and not processed. The file reader lists neither hidden nor empty files, so only frames from elsewhere count them as skipped."""
    keep = mined(F.col("path"), F.col("length"), root, ignore)
    good = keep & F.col("content").isNotNull()
    return files.agg(F.count_if(good).alias("files_processed"), F.count_if(~keep).alias("files_skipped"),
                     F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(keep & F.col("content").isNull()).alias("errors"))


def conversation_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chat export's raw lines, trimmed, ten to a row: (room, source_path, source_type, chunk_index, content).
    Lines keep their order by file and by place in it, which Spark's splits of a text file follow."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    rows = text.batch_lines(lines, ["file", "place"], "line", LINES)
    return rows.select(F.lit("chat").alias("room"), F.lit(path).alias("source_path"), F.lit("conversation").alias("source_type"), F.col("batch").cast("int").alias("chunk_index"), "content")


def snippet(spark: SparkSession, content: str, room: str, source: str) -> DataFrame:
    row = (room, source, "memory", 0, content)
    return spark.createDataFrame([row], "room string, source_path string, source_type string, chunk_index int, content string")
