"""Text embeddings. No model is shipped: the stand-in hashes words and their beginnings into a vector of unit length, so
texts that share words are near. Any other embedder with the same two methods may take its place."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WORDS = 512


class HashEmbedder:
    """Deterministic, not semantic. A text without words gives a zero vector."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for word in re.findall(r"\w+", text.lower())[:MAX_WORDS]:
            for part, weight in ((word, 1.0), (word[:5] + "*", 0.5)):
                code = zlib.crc32(part.encode("utf-8", "surrogatepass"))
                out[code % self.dim] += weight if code >> 31 else -weight
        size = np.linalg.norm(out)
        return (out / size if size else out).astype(np.float32).tolist()

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            own = HashEmbedder(dim)
            return texts.map(lambda t: None if t is None else own.embed(t))

        return run(text)
