"""Deterministic draws: a row's place in a seeded order is that of md5(seed/id).

The order depends on the seed and the id alone, never on partitions; the first n rows
of a seed are part of its first m for n <= m; seeds are independent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: str | Column, *ids: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws("/", seed, *[i.cast("string") for i in ids]))


def coin(seed: str, id_: Column) -> Column:
    """A fair bit of each id: whether the first hex digit of its key is 8 or more."""
    return F.substring(draw_key(seed, id_), 1, 1) >= "8"
