"""Keyed hashes: the same row gets the same draw however the data is partitioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts) -> Column:
    """32-bit integer of the md5 of the parts joined by ``|``; plain strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = reduce(lambda a, b: F.concat(a, F.lit("|"), b), columns)
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")
