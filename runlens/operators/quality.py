"""Compare two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.keys import join_keys


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Rows present on one side only, or with any ``|a - b| >= eps`` (or a value missing on one side only). NULL keys pair up."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_in_b"))
    both = join_keys(left, right, keys, "full_outer")
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        differs = differs | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) >= eps, F.lit(False))
    status = F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").otherwise("differs")
    return both.where(differs).withColumn("status", status).drop("_in_a", "_in_b")
