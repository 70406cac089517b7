"""Vectors held as array<double>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of different or no length or without a direction."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(fits & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def from_bytes_udf():
    """Pandas UDF that reads vectors stored as little-endian 64-bit floats."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f8"))

    return decode
