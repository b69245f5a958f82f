"""Repeatable randomness: draws that depend on the row's key, not on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: object, *keys: Column) -> Column:
    """A number strictly between 0 and 1, taken from the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    first_word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (first_word + F.lit(0.5)) / F.lit(2.0**32)
