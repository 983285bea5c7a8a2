"""Sharding by a minimax contiguous partition: the smallest shard capacity over ordered atomic groups.

Rows with equal text are one atomic group. Groups are ordered by a hash of their text and cut into contiguous shards.
The smallest feasible capacity is found by binary search with a greedy check. The search sees the order as a list of
leaves: ranges of hashes with their total size. It starts with 2**FIRST ranges and splits, by one aggregate job per
round, only those ranges in which a cut may fall, until all such ranges hold one group. So the driver holds a few
hundred thousand numbers at any input size, and the result is the exact optimum over single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import fresh, saved

FIRST = 12
STEP = 8
#: Most rows numbered at a time. A range of hashes with several times its share of rows is cut as well.
BLOCK_ROWS = 1 << 19
UNEVEN = 4


class Leaves:
    """Ranges of the hash order with their total size; ``whole`` marks those that hold at most one group."""

    def __init__(self, start: np.ndarray, bits: np.ndarray, size: np.ndarray, groups: np.ndarray):
        order = np.argsort(start)
        self.start, self.bits, self.size, self.groups = start[order], bits[order], size[order], groups[order]
        self.whole = (self.groups <= 1) | (self.bits >= 64)
        self.prefix = np.r_[0, np.cumsum(self.size)]

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy check: leaf numbers at which shards end, every shard as full as whole leaves allow; None if it fails."""
        at, out, n = 0, [], len(self.size)
        for _ in range(shards):
            at = int(np.searchsorted(self.prefix, self.prefix[at] + capacity, side="right")) - 1
            out.append(at)
            if at == n:
                return out + [n] * (shards - len(out))
        return None

    def fluid(self, capacity: int, shards: int) -> list[int] | None:
        """As if leaves of several groups could be cut anywhere: sizes at which shards end, at the latest."""
        at, out, total = 0, [], int(self.prefix[-1])
        for _ in range(shards):
            at = min(at + capacity, total)
            i = int(np.searchsorted(self.prefix, at, side="right")) - 1
            if i < len(self.size) and self.whole[i]:
                at = int(self.prefix[i])
            out.append(at)
            if at == total:
                return out + [total] * (shards - len(out))
        return None

    def smallest(self, check, shards: int) -> int:
        total = int(self.prefix[-1])
        low, high = -(-total // shards), max(total, 1)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if check(middle, shards) is not None else (middle + 1, high)
        return low

    def open_ranges(self, shards: int) -> np.ndarray:
        """Leaves of several groups in which a cut of the best partition may fall."""
        most, least = self.smallest(self.cuts, shards), self.smallest(self.fluid, shards)
        large = np.flatnonzero(~self.whole & (self.size > least))
        if len(large):  # such a range may hold a single large group that decides the capacity
            return large
        first = self._earliest(least, shards)
        last = self.fluid(most, shards)
        hit = np.zeros(len(self.size), dtype=bool)
        for low, high in zip(first, last):
            a = int(np.searchsorted(self.prefix, low, side="right")) - 1
            b = int(np.searchsorted(self.prefix, high, side="left"))
            hit[max(a, 0) : b + 1] = True
        return np.flatnonzero(hit & ~self.whole)

    def _earliest(self, capacity: int, shards: int) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            i = int(np.searchsorted(self.prefix, at + capacity, side="right")) - 1
            at = int(self.prefix[i])
            out.append(at)
        return out


def _signed_floor(h: Column, bits: Column | int) -> Column:
    """First hash of the range of 2**(64-bits) hashes that holds h."""
    free = F.lit(64) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.call_function("shiftleft", F.call_function("shiftright", h, free), free)


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the first hash of each shard after the first.

    ``groups`` has one row (h long, size long) per atomic group. Shards are as full as the capacity allows unless an
    even cut, at the nearest boundary to equal shares of what is left, keeps to it as well.
    """

    def leaves_of(df: DataFrame, bits: int):
        rows = df.withColumn("_start", _signed_floor(F.col("h"), bits)).groupBy("_start").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return (
            np.array([r["_start"] for r in rows], dtype=np.int64), np.full(len(rows), bits),
            np.array([r["s"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64),
        )

    leaves = Leaves(*leaves_of(groups, FIRST))
    while len(opened := leaves.open_ranges(shards) if len(leaves.size) else []):
        parts = [tuple(a[~np.isin(np.arange(len(leaves.size)), opened)] for a in (leaves.start, leaves.bits, leaves.size, leaves.groups))]
        for bits in sorted({int(b) for b in leaves.bits[opened]}):
            starts = [int(s) for s, b in zip(leaves.start[opened], leaves.bits[opened]) if b == bits]
            parts.append(leaves_of(groups.where(_signed_floor(F.col("h"), bits).isin(starts)), min(64, bits + STEP)))
        leaves = Leaves(*(np.concatenate(a) for a in zip(*parts)))
    if not len(leaves.size):
        return 0, []
    capacity = leaves.smallest(leaves.cuts, shards)
    ends = _even(leaves, capacity, shards) or leaves.cuts(capacity, shards)
    last = len(leaves.start)
    return capacity, [int(leaves.start[e]) if e < last else None for e in ends[:-1]]


def _even(leaves: Leaves, capacity: int, shards: int) -> list[int] | None:
    at, out, p = 0, [], leaves.prefix
    for left in range(shards, 0, -1):
        want = p[at] + (p[-1] - p[at]) / left
        i = int(np.searchsorted(p, want))
        near = min((k for k in (i - 1, i) if at <= k < len(p)), key=lambda k: abs(p[k] - want), default=at)
        while near > at and p[near] - p[at] > capacity:
            near -= 1
        at = near if left > 1 else len(p) - 1
        out.append(at)
    sizes = np.diff(p[[0, *out]])
    return out if sizes.max() <= capacity else None


def shard_of(h: Column, cuts: list[int | None]) -> Column:
    """Number of cuts at or below the hash."""
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + F.when(h >= F.lit(c), 1).otherwise(0)
    return out


def slots(df: DataFrame, shard: str = "shard", order: str = "h", tie: str = "doc_id") -> DataFrame:
    """Gapless number from 0 within each shard.

    Rows are numbered per block: a range of hashes, and within a hot range a hash of the row's id, so that blocks are
    of like size, and of BLOCK_ROWS rows at most, however many rows share a text. Offsets come from the counts of earlier blocks.
    """
    parted = df.withColumn("_range", _signed_floor(F.col(order), FIRST))
    counted = {r["_range"]: r["n"] for r in parted.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2**FIRST rows
    most = max(1, min(BLOCK_ROWS, UNEVEN * sum(counted.values()) >> FIRST))
    pieces = {start: -(-n // most) for start, n in counted.items() if n > most}
    salt = F.lit(0)
    if pieces:
        listed = F.create_map(*[F.lit(v) for start_pieces in pieces.items() for v in start_pieces])
        salt = F.pmod(F.xxhash64(F.col(tie), F.lit("slot")), F.coalesce(F.element_at(listed, F.col("_range")), F.lit(1)))
    blocks = parted.withColumn("_salt", salt.cast("long"))
    key = [shard, "_range", "_salt"]
    before = Window.partitionBy(shard).orderBy("_range", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(order, tie))
    return blocks.withColumn("_number", number).join(counts, key).withColumn("slot", F.col("_before") + F.col("_number") - 1).drop("_range", "_salt", "_before", "_number")


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row, equal texts together in one shard.

    Size is the text's UTF-8 length plus 1; a NULL text is a group of its own, of size 1 a row and with a NULL crc.
    Repeated rows each get a slot. NULL ids are allowed. An empty table gives an empty result; then, and with fewer
    groups than shards, some shards stay empty. Columns in ``extra`` are carried along.
    """
    h = fresh(docs, "_h")
    hashed = F.coalesce(F.xxhash64(text), F.lit(0)).alias(h)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")
    sizes = saved(docs.select(hashed.alias("h"), size).groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = capacity_and_cuts(sizes, shards)
    rows = docs.select(F.col(doc_id).alias("doc_id"), size, F.crc32(F.col(text)).alias("text_crc32"), hashed, *(extra or []))
    rows = rows if extra else saved(rows, "shard-rows")
    return slots(rows.withColumn("shard", shard_of(F.col(h), cuts).cast("int")), order=h).drop(h)
