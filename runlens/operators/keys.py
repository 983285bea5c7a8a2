"""Joins on keys in which NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the column that holds all keys of a row.
KEY = "_key"


def packed(keys: Sequence[str], like: T.StructType | None = None) -> Column:
    """All key columns as one struct. Structs are equal where their fields are, NULL or not, so plain joins and
    aggregates on it pair NULL keys and keep its partitioning. With ``like``, fields get the types they have there."""
    return F.struct(*[F.col(k).cast(like[k].dataType).alias(k) if like is not None else F.col(k) for k in keys]).alias(KEY)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that pairs NULL keys. The key columns appear once; for an outer join they come from either side."""
    twin = {k: f"_right_{k}" for k in keys}
    renamed = right.select(*[F.col(k).alias(t) for k, t in twin.items()], *[c for c in right.columns if c not in twin])
    joined = left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in twin.items()]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in [*left.columns, *renamed.columns] if c not in twin and c not in twin.values()]
    either = how in ("full_outer", "outer", "full", "right", "right_outer")
    return joined.select(*[F.coalesce(k, t).alias(k) if either else F.col(k) for k, t in twin.items()], *rest)
