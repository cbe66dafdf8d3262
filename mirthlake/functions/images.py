"""Perceptual hashes of grey images, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether each of 8x9 sampled points is darker than its right neighbour."""
    h, w = grey.shape
    rows, cols = (np.arange(8) * h) // 8, (np.arange(9) * (w - 1)) // 8
    s = grey[np.ix_(rows, cols)].astype(np.int32)
    return f"{int(''.join('1' if x else '0' for x in (s[:, :-1] < s[:, 1:]).ravel()), 2):016x}"


def cosine_hash(grey: np.ndarray) -> str:
    """64 bits: which of the 8x8 lowest cosine terms exceed the median of all but the first."""
    n = grey.shape[0]
    k = np.arange(8)[:, None]
    basis = np.cos((2 * np.arange(n)[None, :] + 1) * k * np.pi / (2 * n))
    t = basis @ grey.astype(float) @ basis.T
    flat = t.ravel()
    return f"{int(''.join('1' if x > np.median(flat[1:]) else '0' for x in flat), 2):016x}"


@F.pandas_udf(StructType([StructField("dhash", StringType()), StructField("phash", StringType())]))
def perceptual_hashes(pixels: pd.Series) -> pd.DataFrame:
    """Hashes of 32x32 grey images given as 1024 bytes; null for anything else."""
    rows = []
    for p in pixels:
        ok = p is not None and len(p) == 1024
        g = np.frombuffer(bytes(p), np.uint8).reshape(32, 32) if ok else None
        rows.append((difference_hash(g), cosine_hash(g)) if ok else (None, None))
    return pd.DataFrame(rows, columns=["dhash", "phash"])
