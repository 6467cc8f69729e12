"""Incremental ingest with Structured Streaming (an extension): files that appear in a folder are mined once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text
from tessera.palace import Palace
from tessera.sources import mining


def mine_stream(spark: SparkSession, path: str, palace: Palace, wing: str, checkpoint: str, *, trigger: dict | None = None, max_files: int = 1000, now=time.time) -> StreamingQuery:
    """Start a query that inserts the chunks of new files; each micro-batch takes at most max_files. Content hashes make a
    batch that runs twice harmless. trigger: as for DataStreamWriter.trigger (default: what is there now, then stop)."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path)
    )

    def insert(batch: DataFrame, _: int) -> None:
        rows = mining.file_chunks(batch, path, text.MAX_CHUNK, text.OVERLAP).drop("start", "end")
        palace.insert(rows, wing, "auto-mined", int(now()))

    return files.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
