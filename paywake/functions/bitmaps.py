"""Distinct counts of listed values by bitmaps: 64-bit columns that merge in any order."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def bitmaps(value: Column, codes: list[str], name: str) -> dict[str, Column]:
    """One column per BITS codes, with the bit of the value set, or NULL where the value is not in that bucket.

    ``codes`` are sorted, so a row looks at the codes of its own bucket only.
    """
    buckets = [codes[at:at + BITS] for at in range(0, len(codes), BITS)]
    columns = {}
    for no, bucket in enumerate(buckets):
        place = F.array_position(F.array(*map(F.lit, bucket)), value)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))
        columns[f"{name}_{no}"] = F.when(value.between(bucket[0], bucket[-1]) & (place > 0), bit)
    return columns


def bitmap_size(columns: Iterable[str]) -> Column:
    """Number of bits set in all of the columns, NULL being none."""
    return sum((F.coalesce(F.bit_count(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
