"""Order-dependent work on groups of any size.

A run, log or file may hold a large share of all rows, so nothing here sorts a huge group in one task. Groups are
cut into blocks of neighbouring order values and processed per (group, block). What a block needs to know about the
blocks before it comes from a small per-block summary: a prefix scan in two passes. Where only huge groups shall be
cut, ``with_blocks`` finds those above ``HOT_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.keys import join_keys

DEFAULT_BITS = 16
HOT_ROWS = 1 << 20
BLOCK = "_block"


def block_of(order: str | Column, bits: int = DEFAULT_BITS) -> Column:
    """Block number of an integer order column (floor division by ``2**bits``)."""
    order = F.col(order) if isinstance(order, str) else order
    return F.shiftright(order.cast("long"), bits)


def with_blocks(df: DataFrame, keys: Sequence[str], block: Column, hot_rows: int | None = None) -> DataFrame:
    """Add ``_block``: the given block for rows of huge groups, NULL for all others.

    There are at most (rows / ``hot_rows``) huge groups; adaptive execution broadcasts their keys when they are small.
    A NULL key is a group. Without keys the whole table is one group and always cut.
    """
    if not keys:
        return df.withColumn(BLOCK, block)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    marked = join_keys(df, hot.select(*keys, F.lit(True).alias("_hot")), keys, "left")
    return marked.withColumn(BLOCK, F.when(F.col("_hot"), block)).drop("_hot")


def running_sum(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], block: Column, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` (a whole number) over the rows up to and including each row in its group's order.

    ``block`` must be a coarsening of the leading order columns, so that blocks sort like rows do. Two passes: a narrow
    one adds up each (group, block), and the sums of all earlier blocks enter a block as one row before all others; the
    second one runs over each block by itself. Groups of one block send no such row. Nothing is joined, so a NULL key is a group.
    """
    rows = df.withColumns({BLOCK: block, "_amount": F.coalesce(amount.cast("long"), F.lit(0))})
    sums = rows.groupBy(*keys, BLOCK).agg(F.sum("_amount").alias("_amount"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, BLOCK, F.sum("_amount").over(earlier).alias("_amount")).where("_amount <> 0")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keys]
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried.select(*keys, *empty, BLOCK, "_amount", F.lit(False).alias("_own")))
    up_to_here = Window.partitionBy(*keys, BLOCK).orderBy("_own", *order_by).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_sum", F.sum("_amount").over(up_to_here)).where("_own").drop(BLOCK, "_amount", "_own").withColumnRenamed("_sum", name)


def last_before(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], block: Column, value: Column, name: str, before: DataFrame | None = None) -> DataFrame:
    """Last non-NULL ``value`` of the rows before each row in its group's order; NULL where there is none.

    Two passes as in ``running_sum``: the last value of all earlier blocks enters a block as one row. ``before`` holds
    one row ``(keys, value)`` per group that comes before all others.
    """
    rows = df.withColumns({BLOCK: block, "_value": value})
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    every = rows.groupBy(*keys, BLOCK).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), at)).alias("_last"))
    if before is not None:
        lowest = F.lit(None).cast(rows.schema[BLOCK].dataType).alias(BLOCK)  # NULL sorts first
        every = every.unionByName(before.select(*keys, lowest, F.col(before.columns[-1]).alias("_last")))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, BLOCK, F.last("_last", ignorenulls=True).over(earlier).alias("_value")).where(F.col("_value").isNotNull() & F.col(BLOCK).isNotNull())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keys]
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried.select(*keys, *empty, BLOCK, "_value", F.lit(False).alias("_own")))
    up_to_here = Window.partitionBy(*keys, BLOCK).orderBy("_own", *order_by).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_last", F.last("_value", ignorenulls=True).over(up_to_here)).where("_own").drop(BLOCK, "_value", "_own").withColumnRenamed("_last", name)


def dense_positions(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], block: Column, name: str = "pos") -> DataFrame:
    """0-based position of each row in its group's order; blocks as for ``running_sum``."""
    return running_sum(df, keys, order_by, block, F.lit(1), name).withColumn(name, F.col(name) - 1)


def running_count(df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str, bits: int = DEFAULT_BITS) -> DataFrame:
    """Number of rows up to and including this one for which ``flag`` holds, within the group."""
    return running_sum(df, keys, [order], block_of(order, bits), flag.cast("long"), name)


def with_halo(df: DataFrame, pos: str, before: int, after: int, bits: int = DEFAULT_BITS) -> DataFrame:
    """Copy rows near a block edge into the neighbour block that needs them.

    Afterwards a ROWS frame of ``before`` preceding and ``after`` following rows can run per block. Rows
    with ``_own`` = false only serve as context and must be dropped after the window.
    """
    bits = max(bits, (4 * (before + after + 1)).bit_length())
    p = F.col(pos).cast("long")
    first = F.greatest(F.shiftright(p - after, bits), F.lit(0).cast("long"))
    return df.withColumn(BLOCK, F.explode(F.sequence(first, F.shiftright(p + before, bits)))).withColumn(
        "_own", F.col(BLOCK) == F.shiftright(p, bits)
    )
