"""A Spark data source for NumPy files: spark.read.format("npy").load(path) gives (rowid, vector).

Files are version 1 with little-endian 32-bit floats in C order: (n, d) is n vectors, (n,) is one of n dimensions, (0,)
none. A large file is read in ranges of rows, one partition each."""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 65_536


def open_input(path: str):
    store, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    return store.open_input_file(where)


def header(f) -> tuple[int, int, int]:
    """(rows, dimensions, place of the data) of an open file; ValueError where it isn't of the form above."""
    if f.read(6) != b"\x93NUMPY" or f.read(2)[:1] != b"\x01":
        raise ValueError("not a NumPy file of version 1")
    size = struct.unpack("<H", f.read(2))[0]
    said = ast.literal_eval(f.read(size).decode("latin-1"))
    if said["descr"] != "<f4" or said["fortran_order"]:
        raise ValueError("only 32-bit little-endian floats in C order are read")
    shape = said["shape"]
    if len(shape) not in (1, 2):
        raise ValueError("only arrays of one or two dimensions are read")
    n, d = shape if len(shape) == 2 else ((1, shape[0]) if shape[0] else (0, 0))
    if f.size() - 10 - size != 4 * n * d:
        raise ValueError("the data isn't as long as the header says")
    return n, d, 10 + size


def rows_of(f, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """(rowid, vector) of the rows of an open file from start up to stop."""
    import numpy as np

    f.seek(0)
    rows, d, place = header(f)
    for at in range(start, rows if stop is None else stop, 1024):
        n = min(1024, (rows if stop is None else stop) - at)
        f.seek(place + 4 * d * at)
        block = np.frombuffer(f.read(4 * d * n), dtype="<f4").reshape(n, d)
        yield from ((at + i, row.tolist()) for i, row in enumerate(block))


WRITTEN = "path string, ids array<long>"


def writer(place: str):
    """A function for mapInPandas that writes each frame of (id, embedding) as a .npy file in a folder: its path, and the ids
    of its rows in order. Names are new each time, so a task that runs twice leaves a file that no row names."""
    def run(frames):
        import io
        import uuid

        import numpy as np
        import pandas as pd

        store, root = fs.FileSystem.from_uri(place)
        for f in frames:
            if len(f):
                raw, name = io.BytesIO(), uuid.uuid4().hex
                np.save(raw, np.array(f["embedding"].tolist(), dtype="<f4"))
                store.create_dir(root, recursive=True)
                with store.open_output_stream(f"{root}/{name}.npy") as out:
                    out.write(raw.getvalue())
                yield pd.DataFrame({"path": [f"{place}/{name}.npy"], "ids": [f["id"].tolist()]})

    return run


class NpyEach:
    """The table function npy_each(path): the rows of a file, for each path that it meets; the source reads one large file in
    several tasks, this many files where their paths are rows. A null path has no rows."""

    def eval(self, path: str):
        if path is not None:
            with open_input(path) as f:
                yield from rows_of(f)


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Rows]:
        with open_input(self.path) as f:
            n, _, _ = header(f)
        return [Rows(at, min(n, at + ROWS)) for at in range(0, n, ROWS)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with open_input(self.path) as f:
            yield from rows_of(f, partition.start, partition.stop)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "rowid long, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])
