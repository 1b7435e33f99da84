"""Equi joins in which NULL keys match each other."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _renamed(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The right side under key names of its own, and the condition."""
    kept = [c for c in right.columns if c not in keys]
    named = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *kept)
    return named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Left columns, then the right columns without its keys. Other column names must not repeat."""
    kept = [c for c in right.columns if c not in keys]
    return left.join(*_renamed(right, keys), how).select(*left.columns, *kept)


def semi_join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Left rows that have a partner, or with ``left_anti`` those that have none."""
    return left.join(*_renamed(right, keys), how)
