"""Text functions: chunks, hashes, file names, keywords, transcripts. Lengths and places are in UTF-8 bytes; a cut that
would fall inside a character moves back to where it starts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHUNK, OVERLAP = 2048, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\r\x0b\x0c"
#: File name extensions that are skipped, and parts of names that are.
SKIPPED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp",
    ".mp3", ".mp4", ".wav", ".avi", ".mkv", ".mov",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".o", ".a",
    ".bin", ".dat", ".db", ".sqlite",
    ".wasm", ".pyc", ".class",
    ".lock", ".sum",
]
SKIPPED_PARTS = [".db-wal", ".db-shm", "node_modules", "__pycache__"]
MAX_FILE_BYTES = 10 * 1024 * 1024


def char_start(raw: bytes, at: int) -> int:
    """The last place not beyond `at` where a character of UTF-8 text starts."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut(raw: bytes, max_chunk: int = MAX_CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Windows of at most max_chunk bytes that overlap. A window that isn't the last ends after its last blank line or,
    where it has none, after its last line feed, provided that this is beyond its first quarter."""
    if not 0 <= overlap < max_chunk // 4:
        raise ValueError("the overlap must be under a quarter of a chunk")
    at = 0
    while len(raw) - at > max_chunk:
        window, mark = raw[at : at + max_chunk], b"\n\n"
        found = window.rfind(mark)
        if found < 0:
            mark = b"\n"
            found = window.rfind(mark)
        end = at + found + len(mark) if found > max_chunk // 4 else char_start(raw, at + max_chunk)
        yield at, end
        at = char_start(raw, end - overlap)
    yield at, len(raw)


def chunks(text: Column, max_chunk: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """The chunks of a text, an array of (chunk_index, start, end, content); an empty text is one empty chunk, null gives null. Texts are cut whole; Python gives the
    places only, as Arrow arrays, and Spark takes the chunks of a row from its text, so that no worker holds a batch's chunks."""
    @F.arrow_udf("array<struct<start:long,end:long>>")
    def places(texts: pa.Array) -> pa.Array:
        first, found = array("q"), array("q")
        for x in texts.cast(pa.large_binary()):
            first.append(len(found) // 2)
            if x.is_valid:
                for place in cut(x.as_py(), max_chunk, overlap):
                    found.extend(place)
        both = np.frombuffer(found, dtype=np.int64).reshape(-1, 2) if found else np.empty((0, 2), dtype=np.int64)
        own = pa.StructArray.from_arrays([pa.array(both[:, i]) for i in (0, 1)], ["start", "end"])
        at = np.append(np.frombuffer(first, dtype=np.int64), len(both)).astype(np.int32)
        null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
        return pa.ListArray.from_arrays(pa.array(at, mask=null), own)

    def one(row: Column) -> Column:
        piece = lambda c: F.substring(row.raw, (c.start + 1).cast("int"), (c.end - c.start).cast("int")).cast("string")
        return F.transform(row.places, lambda c, i: F.struct(i.alias("chunk_index"), c.start.alias("start"), c.end.alias("end"), piece(c).alias("content")))

    # each row's bytes are taken once, not for each chunk
    return F.transform(F.array(F.struct(text.cast("binary").alias("raw"), places(text).alias("places"))), one)[0]


def chunked(df: DataFrame, column: str, max_chunk: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk: df's other columns, then chunk_index, start, end, content."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline(chunks(F.col(column), max_chunk, overlap)))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(ASCII_SPACE))


def _continues(raw: Column, at: int) -> Column:
    """Whether byte `at` (from 1) of raw is inside a character."""
    return F.hex(F.substring(raw, at, 1)).rlike("^[89AB]")


def prefix_bytes(text: Column, size: int) -> Column:
    """The first `size` bytes of a text, fewer where a character would be cut."""
    raw = text.cast("binary")
    end = F.when(~_continues(raw, size + 1), size).when(~_continues(raw, size), size - 1).when(~_continues(raw, size - 1), size - 2).otherwise(size - 3)
    return F.when(F.octet_length(raw) <= size, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def suffix_bytes(text: Column, size: int) -> Column:
    """The last `size` bytes of a text, fewer where a character would be cut."""
    raw = text.cast("binary")
    first = F.octet_length(raw) - size + 1
    inside = lambda k: F.hex(F.substring(raw, first + k, F.lit(1))).rlike("^[89AB]")
    skip = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(raw) <= size, text).otherwise(F.decode(F.substring(raw, first + skip, F.lit(size)), "UTF-8"))


def preview(text: Column, size: int = 200, always: bool = False) -> Column:
    """The first bytes of a text, with dots where it is longer (or always)."""
    short = prefix_bytes(text, size)
    return F.concat(short, F.lit("...")) if always else F.when(F.octet_length(text) > size, F.concat(short, F.lit("..."))).otherwise(short)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(name: Column) -> Column:
    """From the last dot of a base name on; a name that only starts with a dot has none."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def should_skip(name: Column, more: list[str] | None = None) -> Column:
    """Whether a file of that base name is left out: hidden, of a skipped extension, or with a skipped part.
    `more` are parts of names to skip besides the fixed ones, such as a store's own files."""
    skip = name.startswith(".") | ascii_lower(extension(name)).isin(SKIPPED_EXTENSIONS)
    for part in SKIPPED_PARTS + (more or []):
        skip = skip | name.contains(part)
    return skip


def glob_pattern(glob: str) -> str:
    """The pattern of paths that a glob as in ignore files means: * and ? stay within a name, ** crosses folders, [...] is a set;
    one with a slash before its end is taken from the root, another from any folder; a slash at the end means folders
    only. What lies in a folder that matches matches too."""
    folder, body = glob.endswith("/"), glob.rstrip("/")
    anchored, body, out, i = "/" in body, body.lstrip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inside = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^/" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether ignore globs leave a path (from the root on) out: the last that matches decides, and one that begins with ! takes
    a path in again. Blank ones and those that begin with # mean nothing."""
    out = F.lit(False)
    for g in (g.strip() for g in globs):
        if g and not g.startswith("#"):
            keep = g.startswith("!")
            out = F.when(path.rlike(glob_pattern(g[keep:])), F.lit(not keep)).otherwise(out)
    return out


def size_fits(size: Column) -> Column:
    return size.between(1, MAX_FILE_BYTES)


def input_kind(name: Column, is_dir: Column) -> Column:
    """'directory', 'conversation' or 'file': how an input is read."""
    return F.when(is_dir, "directory").when(ascii_lower(extension(name)).isin(".json", ".jsonl"), "conversation").otherwise("file")


def keywords(query: Column) -> Column:
    """Words of over three bytes, in their order, with repeats."""
    return F.filter(F.split(query, r"[ ,.?!;:\t\n]+"), lambda w: F.octet_length(w) > 3)


def keyword_list(query: str) -> list[str]:
    """keywords() of one text on the driver."""
    for mark in ",.?!;:\t\n":
        query = query.replace(mark, " ")
    return [w for w in query.split(" ") if len(w.encode("utf-8", "surrogatepass")) > 3]


def keyword_share(text: Column, words: list[str]) -> Column:
    """The share of words that text has, A-Z in either case; 0 without words."""
    if not words:
        return F.lit(0.0)
    low = ascii_lower(text)
    hits = [F.contains(low, F.lit(w.translate(str.maketrans(UPPER, LOWER)))).cast("int") for w in words]
    out = hits[0]
    for h in hits[1:]:
        out = out + h
    return out / F.lit(float(len(words)))


def recency(created_at: Column, now: int, horizon: int = 90 * 86400) -> Column:
    """1 for what was made now or later, falling to 0 at the horizon (seconds)."""
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(now) - created_at) / F.lit(float(horizon))))


def batch_lines(df: DataFrame, order: list[str], line: str, n: int = 10) -> DataFrame:
    """(batch, content, lines): lines trimmed, blank ones dropped, n at a time joined with a line feed after each.

    order: the columns that order the lines. Lines are numbered across partitions (see numbering), never in one task."""
    from tessera.operators.numbering import numbered

    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], trimmed(F.col(line)).alias("_line")).where(F.length("_line") > 0)
    rows = numbered(rows, [F.col(f"_{i}") for i in range(len(order))], "_at", start=0)
    each = rows.withColumn("batch", F.floor(F.col("_at") / n)).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("lines"))
    return each.select("batch", F.array_join(F.transform("lines", lambda x: F.concat(x["_line"], F.lit("\n"))), "").alias("content"), F.size("lines").alias("lines"))


def role(kind: Column, message_role: Column) -> Column:
    """A transcript entry's role: its type where that is user or assistant, else the message's own."""
    return F.coalesce(F.when(kind.isin("user", "assistant"), kind), message_role)


def content_text(content: Column) -> Column:
    """The text of a transcript entry's content (JSON): a string as it is; of an array, each text block and a space after it."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: F.concat(b["text"], F.lit(" "))), "")
    plain = F.variant_get(F.try_parse_json(content), "$", "string")
    return F.when(F.ltrim(content).startswith("["), texts).when(F.ltrim(content).startswith('"'), plain)


def rendered(role: Column, text: Column) -> Column:
    """A turn of a transcript; null for other roles and blank texts, which are left out."""
    said = F.when(role == "user", "User: ").when(role == "assistant", "Assistant: ")
    return F.when(said.isNotNull() & (F.length(trimmed(text)) > 0), F.concat(said, text, F.lit("\n\n")))


def transcript_tail(df: DataFrame, key: list[str], order: list[str], role_col: str, text_col: str, max_bytes: int = 6000, min_bytes: int = 40) -> DataFrame:
    """(key, content): for each transcript its last max_bytes bytes; none where less than min_bytes are left.

    Only turns that reach into the tail are gathered: a running sum of bytes from the end, by key, drops the others."""
    from pyspark.sql import Window

    by = [f"_{i}" for i in range(len(order))]
    turns = df.select(*key, *[F.col(c).alias(b) for c, b in zip(order, by)], rendered(F.col(role_col), F.col(text_col)).alias("_turn")).where("_turn IS NOT NULL")
    later = Window.partitionBy(*key).orderBy(*[F.desc(b) for b in by]).rowsBetween(Window.unboundedPreceding, -1)
    near = turns.withColumn("_after", F.coalesce(F.sum(F.octet_length("_turn")).over(later), F.lit(0))).where(F.col("_after") < max_bytes)
    whole = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*by, "_turn"))).alias("turns"))
    tail = whole.select(*key, suffix_bytes(F.array_join(F.transform("turns", lambda t: t["_turn"]), ""), max_bytes).alias("content"))
    return tail.where(F.octet_length("content") >= min_bytes)


def json_string(doc: Column, path: str) -> Column:
    """A string at a path, null for other types; an empty string is null."""
    value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    return F.nullif(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(doc), path, "string")), F.lit(""))


def json_int(doc: Column, path: str) -> Column:
    """A whole number at a path, of an integer, of a float within 1e18 either way, or of a string of digits; else null."""
    value = F.try_parse_json(doc)
    number = F.try_variant_get(value, path, "double")
    whole = F.try_variant_get(value, path, "bigint")
    text = F.try_variant_get(value, path, "string")
    return F.when(F.abs(number) <= 1e18, F.coalesce(whole, number.cast("bigint"))).otherwise(F.when(text.rlike(r"^[-+]?[0-9]{1,18}$"), text.try_cast("bigint")))


#: Events and their former spellings.
EVENTS = {"SessionStart": ["sessionstart", "session-start"], "PreCompact": ["precompact"], "Stop": ["stop"]}


def event_route(name: Column, old_name: Column) -> Column:
    """The event that a hook's name stands for, by either spelling and in any case; 'unknown' for others."""
    low = ascii_lower(F.coalesce(F.nullif(name, F.lit("")), F.nullif(old_name, F.lit("")), F.lit("unknown")))
    out = F.lit("unknown")
    for event, spellings in EVENTS.items():
        out = F.when(low.isin(spellings), event).otherwise(out)
    return out


def safe_version(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[0-9.-]{1,32}\z"), F.lit(False))
