"""Order without chance: numbers that depend on the seed and the parts alone."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 63) - 1


def stable_uint_py(*parts: object) -> int:
    """63 bits of BLAKE2b over the NUL-joined parts."""
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "big") & MASK


@F.pandas_udf(T.LongType())
def _blake2b63(values: pd.Series) -> pd.Series:
    return values.map(lambda v: int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "big") & MASK)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _blake2b63_each(starts: pa.Array, lists: pa.Array) -> pa.Array:
    values, at, digests = lists.flatten().to_numpy(zero_copy_only=False).tolist(), 0, []
    sizes = lists.value_lengths().fill_null(0).to_pylist()
    for start, n in zip(starts.to_numpy(zero_copy_only=False).tolist(), sizes, strict=True):
        digests += [blake2b(start + v, digest_size=8).digest() for v in values[at : at + n]]
        at += n
    numbers = np.frombuffer(b"".join(digests), ">u8") & np.uint64(MASK)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(numbers.astype(np.int64)))


def joined(*parts: Column | str | int) -> Column:
    """Parts joined by NUL. A null part is an error, since leaving it out would give another key."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.array_join(F.transform(F.array(*[c.cast("string") for c in columns]), lambda x: F.when(x.isNull(), F.raise_error(F.lit("null in a hash key"))).otherwise(x)), "\0")


def blake2b63(*parts: Column | str | int) -> Column:
    """The contract's hash: one Arrow batch per call into Python, no Spark function computes it."""
    return _blake2b63(joined(*parts))


def sha256_60(*parts: Column | str | int) -> Column:
    """60 bits of SHA-256, computed in the JVM; for plans that must be checked in another engine."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 15), 16, 10).cast("bigint")


Hash = Callable[..., Column]


def hash_each(hash_fn: Hash, parts: list[Column | str | int], values: Column) -> Column:
    """Array of the hashes of the parts followed by each value of an array of strings; no lambda can hold a Python function."""
    if hash_fn is not blake2b63:
        return F.transform(values, lambda v: hash_fn(*parts, v))
    known = F.transform(values, lambda v: F.when(v.isNull(), F.raise_error(F.lit("null in a hash key"))).otherwise(v).cast("binary"))
    return _blake2b63_each(joined(*parts, "").cast("binary"), known)
