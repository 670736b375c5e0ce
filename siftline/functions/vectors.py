"""Vectors from text."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def hashed_vector(size: int):
    """Arrow function text -> unit vector of signed, hashed word counts."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(s):
            hashes = np.fromiter((zlib.crc32(w.encode("utf-8")) for w in (s or "").lower().split()), np.int64)
            signs = np.where(hashes & 0x80000000, 1.0, -1.0)
            v = np.bincount(hashes % size, weights=signs, minlength=size)
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32)

        return texts.map(one)

    return embed
