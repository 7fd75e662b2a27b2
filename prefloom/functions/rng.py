"""Uniform numbers as a function of a seed and the row's own keys.

They don't depend on partitions, retries or row order, so samples and swaps come out the same
on any cluster; ``rand(seed)`` would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key:key...)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def uniform_sql(seed: int | str, *keys: str) -> str:
    """The same number in DuckDB's SQL."""
    text = f"'{seed}'" + "".join(f"||':'||{k}::varchar" for k in keys)
    return f"(('0x'||substr(md5({text}),1,13))::bigint::double/4503599627370496)"


def draw_int(u: Column, low: int, high: int) -> Column:
    """An integer in [low, high] from a uniform number."""
    return (F.floor(u * F.lit(high - low + 1)) + F.lit(low)).cast("int")
