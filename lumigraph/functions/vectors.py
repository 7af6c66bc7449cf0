"""Vector and bit-code expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to norms, so that a zero vector normalises to zeros.
EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its length plus EPSILON."""
    length = norm(v) + EPSILON
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def hex_code(h: Column) -> Column:
    """A 16-digit hex string as a 64-bit integer; null for the empty string."""
    return F.conv(F.nullif(h, F.lit("")), 16, -10).cast("long")


def sign_code(v: Column) -> Column:
    """The signs of a 64-element vector as 16 hex digits, first element first: the threshold step of a perceptual hash."""
    bits = F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two 64-bit integers differ."""
    return F.bit_count(a.bitwiseXOR(b))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows (length plus EPSILON) of an Arrow list column whose lists all have `dim` elements."""
    x = column.cast(pa.large_list(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPSILON)


def float_blob(blob: Column, order: str = "little") -> Column:
    """Bytes of 32-bit floats as an array; null unless they are a whole number of floats."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        kind = "<f4" if order == "little" else ">f4"
        return blobs.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, kind).astype(np.float32))

    return read(blob)
