"""Byte forms of stored vectors and keys, for stores that hold bytes: little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = T.ArrayType(T.FloatType())


def pack(vector: np.ndarray | list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """Whole floats only; a tail of fewer than four bytes is dropped."""
    return np.frombuffer(data, "<f4", len(data) // 4)


def pack_expiring(vector: np.ndarray | list[float], expires_at: int | None) -> bytes:
    """Eight bytes of expiry in seconds (0: none) before the floats."""
    return np.uint64(expires_at or 0).astype("<u8").tobytes() + pack(vector)


def unpack_expiring(data: bytes) -> tuple[int | None, np.ndarray]:
    if len(data) < 8:
        raise ValueError("a stored value begins with eight bytes of expiry")
    return int(np.frombuffer(data, "<u8", 1)[0]) or None, unpack(data[8:])


def prefixed(key: Column, prefix: str = "embermill:") -> Column:
    """The key under which a shared store holds a digest given in hex."""
    return F.concat(F.encode(F.lit(prefix), "utf-8"), F.unhex(key))


@F.pandas_udf(T.BinaryType())
def encode_vector(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else pack(v))


@F.pandas_udf(_FLOATS)
def decode_vector(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else unpack(b))


@F.pandas_udf(T.BinaryType())
def encode_value(vector: pd.Series, expires_at: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else pack_expiring(v, None if pd.isna(e) else int(e)) for v, e in zip(vector, expires_at, strict=True)], dtype=object)


@F.pandas_udf(T.StructType().add("expires_at", T.LongType()).add("vector", _FLOATS))
def decode_value(data: pd.Series) -> pd.DataFrame:
    both = [(None, None) if b is None else unpack_expiring(b) for b in data]
    return pd.DataFrame({"expires_at": pd.array([e for e, _ in both], "Int64"), "vector": [v for _, v in both]})
