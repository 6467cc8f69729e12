"""Operator 8, WARC: a chunked record table.

A payload is rows (record, chunk number, bytes) on both ways. Spark cuts the payloads into chunk rows; the writer is
handed a record's chunks in order and streams them to the archive with a running digest, which must end as the declared
one. The reader streams an archive's bytes and emits each chunk with the digest of the payload so far; what a record's
payload is, in bytes and digest, comes from its chunk rows. So no Python worker or archive holds a payload in one
buffer; the JVM holds it as the one row that it came in.

Archives lie in the shared folder and are opened through pyarrow.fs, so any store that it knows will do. A task writes
its archive under a name of its own and renames it when it is whole, so a task that runs twice leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, materialise, new_path

#: Bytes of a chunk; an Arrow batch has at most 10,000 of them by Spark's default.
CHUNK = 1 << 15
CRLF = b"\r\n"
CHUNKS = ("archive string, record_no long, record_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no long, chunk binary, "
          "sofar_digest string, last boolean")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def sha1_base32(payload) -> "F.Column":
    """Native upper-case base32 of a column's SHA-1: 160 bits are 32 digits of 5 bits, taken from the 40 hex digits."""
    hexes = F.sha1(payload)
    quints = [F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]  # 20 bits each
    at = lambda v: F.substring(F.lit(ALPHABET), v.cast("int") + 1, F.lit(1))
    return F.concat(*[at(F.shiftright(q, s).bitwiseAND(31)) for q in quints for s in (15, 10, 5, 0)])


def with_record_types(rows: DataFrame, min_bytes: int) -> DataFrame:
    """rows (record_id, url, payload) with n, sha256, payload_digest, record_type, refers_to: of equal payloads of min_bytes
    or more, the largest id is the response; a null id is less than any, and with no other beside it a response. Equality is by SHA-1, SHA-256 and length. Types are known by id and payload,
    so ids that several rows have are told apart by what they hold."""
    key = ["n", "payload_digest", "sha256"]
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload")), "sha256": F.sha2("payload", 256)})
    ids = materialise(rows.select("record_id", *key).distinct(), "payloads")
    first = ids.where(F.col("n") >= min_bytes).groupBy(*key).agg(F.max("record_id").alias("first"))
    revisits = materialise(ids.join(first, key).where("first IS NOT NULL AND NOT record_id <=> first").select(F.col("record_id").alias("_id"), *key, "first"), "revisits")
    same = F.col("record_id").eqNullSafe(F.col("_id"))
    for k in key:
        same = same & (rows[k] == revisits[k])
    return rows.join(revisits, same, "left").select("record_id", "url", "payload", *[rows[k] for k in key], "first").select(
        "record_id", "url", "payload", "n", "sha256", "payload_digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first").alias("refers_to"))


def chunk_rows(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each record, in order; a record without a block (empty, or a revisit) has one empty chunk. Rows are
    numbered first and each cuts its own chunk, so that a payload's chunks are never in memory together."""
    block = F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.ceil(block / chunk).cast("int") - 1, F.lit(0))
    head = ["record_id", "url", "n", "sha256", "payload_digest", "record_type", "refers_to"]
    numbers = typed.select(*head, "payload", block.alias("_block"), last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.when(F.col("_block") > 0, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return numbers.select(*head, "chunk_no", piece.alias("chunk"), (F.col("chunk_no") == F.col("_last")).alias("last"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF


def _urn(record_id: int | None, sha256: str) -> str:
    """The record's name: half of it from the payload, half the id (0 without one), so that records of one id have different names."""
    return f"<urn:uuid:{uuid.UUID(int=int(sha256[:16], 16) << 64 | int(record_id or 0) & (2**64 - 1))}>"


def record_id_of(urn: str) -> int:
    x = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


class RecordWriter:
    """Streams records to an archive, chunk by chunk; the digest runs along and must end as the declared one."""

    def __init__(self, out):
        self.out, self.records, self.bytes, self.digest = out, 0, 0, None

    def add(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            revisit = row["record_type"] == "revisit"
            fields = [
                ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["record_id"], row["sha256"])), ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Target-URI", " ".join((row["url"] or "").split()) or "about:blank"), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
                *[("X-No-Id", "1")] * (row["record_id"] is None), ("X-Payload-Length", str(row["n"])), ("Content-Type", "text/html"), ("Content-Length", str(0 if revisit else row["n"])),
            ]
            if revisit:
                fields[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(row["refers_to"], row["sha256"]))]
            self.out.write(_header(fields))
            self.digest, self.records = hashlib.sha1(), self.records + 1
        self.out.write(row["chunk"])
        self.digest.update(row["chunk"])
        self.bytes += len(row["chunk"])
        if row["last"]:
            if row["record_type"] == "response" and base32(self.digest.digest()) != row["payload_digest"]:
                raise ValueError(f"record {row['record_id']}: the chunks don't make up the payload")
            self.out.write(CRLF + CRLF)


def write_archives(chunks: DataFrame, uri: str) -> DataFrame:
    """Write chunk rows, in the order in which they come, as one WARC file per partition under uri; (archive, records, payload_bytes) per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        name, out, writer = uuid.uuid4().hex, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/.{name}.tmp")
                    writer = RecordWriter(out)
                writer.add({k: c[at].as_py() for k, c in zip(batch.schema.names, batch.columns)})
        if out is not None:
            out.close()
            store.move(f"{root}/.{name}.tmp", f"{root}/{name}.warc")
            yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc"], "records": [writer.records], "payload_bytes": [writer.bytes]})

    return chunks.mapInArrow(run, "archive string, records long, payload_bytes long")


def _line(stream) -> bytes:
    return stream.readline()


def read_archive(stream, archive: str) -> Iterator[dict]:
    """The chunk rows of one open archive, one chunk in memory at a time. Raises ValueError where the file is cut or damaged."""
    number = -1
    while True:
        line = _line(stream)
        if not line:
            return
        if line in (CRLF, b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should start: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := _line(stream)).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        if not line:
            raise ValueError(f"{archive}: header without an end")
        left, digest, no, number = int(fields.get("content-length", "0")), hashlib.sha1(), 0, number + 1
        base = {
            "archive": archive, "record_no": number, "record_id": None if "x-no-id" in fields else record_id_of(fields["warc-record-id"]), "record_type": fields["warc-type"],
            "refers_to": record_id_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "declared_bytes": int(fields.get("x-payload-length", left)),
        }
        while left or not no:
            chunk = stream.read(min(CHUNK, left)) if left else b""
            if left and not chunk:
                raise ValueError(f"{archive}: payload is cut")
            digest.update(chunk)
            left -= len(chunk)
            yield base | {"chunk_no": no, "chunk": chunk, "sofar_digest": base32(digest.digest()), "last": not left}
            no += 1


class _Buffered:
    """readline and read over a stream that only has read."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.rest = raw, size, b""

    def _more(self) -> bool:
        got = self.raw.read(self.size)
        self.rest += got
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.rest.find(b"\n")) < 0 and self._more():
            pass
        end = len(self.rest) if end < 0 else end + 1
        out, self.rest = self.rest[:end], self.rest[end:]
        return out

    def read(self, n: int) -> bytes:
        if not self.rest:
            return self.raw.read(n)
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """CHUNKS of every archive named in archives (archive string), about 8 MB of them at a time."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(uri)
        for f in frames:
            for archive in f["archive"]:
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{archive}") as raw:
                    for row in read_archive(_Buffered(raw), archive):
                        held += len(row["chunk"]) + 200
                        rows.append(row)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"record_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"record_id": "Int64", "refers_to": "Int64"})

    return archives.select("archive").mapInPandas(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: record_id, payload_bytes, payload_digest, record_type, refers_to. A response's
    bytes and digest are those of its chunks; a ValueError is raised where they differ from the declared ones."""
    each = chunks.groupBy("archive", "record_no", "record_id", "record_type", "refers_to", "declared_digest", "declared_bytes").agg(
        F.sum(F.octet_length("chunk")).cast("long").alias("n"), F.max_by("sofar_digest", "chunk_no").alias("digest"))
    good = (F.col("record_type") == "revisit") | ((F.col("digest") == F.col("declared_digest")) & (F.col("n") == F.col("declared_bytes")))
    return each.select("record_id", F.col("declared_bytes").alias("payload_bytes"), F.when(good, F.col("declared_digest")).otherwise(
        F.raise_error(F.lit("payload differs from what its record declares")).cast("string")).alias("payload_digest"), "record_type", "refers_to")


def warc_roundtrip(df: DataFrame, id_col: str, payload_col: str, url_col: str | None = None, *, min_bytes: int = 0) -> DataFrame:
    """Write a record per row, read the archives back, one row per record: record_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Null payloads count as empty; a url is folded to one line. Rows with a null id are written and come back without one, as
    revisits of what has their payload and an id. Rows repeated with one id each make a record: with other payloads of their own type, with one payload of the same type. Other columns
    are ignored. An empty table writes no archive.
    """
    spark, uri = df.sparkSession, new_path(df.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).cast("long").alias("record_id"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("payload"))
    archives = materialise(write_archives(chunk_rows(with_record_types(rows, min_bytes)), uri), "archives")
    files = archives.select("archive").repartition(max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism)), "archive")
    return records(read_archives(files, uri))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(documents(spark, sf_dir, "pages"), "page_id", "html", "url").withColumnRenamed("record_id", "page_id")


OP8_SQL = """
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last_id THEN last_id END AS refers_to
    FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id,
                 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + CAST((('0x' || substr(sha1(coalesce(html, '')), 1 + CAST(5 * (i // 4) AS INT), 5))::INT // (CAST(power(32, 3 - i % 4) AS INT))) % 32 AS INT), 1)), '') AS payload_digest
          FROM pages)
"""
