"""Hashes that the JVM has no expression for, as Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def xxh3_64(s: pd.Series) -> pd.Series:
    """XXH3 of the UTF-8 text as a signed 64-bit number; null stays null."""
    import xxhash

    def one(x):
        if x is None:
            return None
        h = xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"))
        return h - (1 << 64) if h >= 1 << 63 else h

    return pd.Series(pd.array([None if x is None or x is pd.NA else one(x) for x in s], dtype="Int64"))
