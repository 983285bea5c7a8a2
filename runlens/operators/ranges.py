"""Id ranges: ``6-8,10,12-13`` texts and the interval rows behind them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from runlens.operators.blocks import BLOCK, DEFAULT_BITS, block_of

PAGE_BITS = 20
#: Ids of a range that one row is expanded to at a time.
EXPAND_BITS = 16


def id_ranges(df: DataFrame, keys: Sequence[str], id_col: str, bits: int = DEFAULT_BITS) -> DataFrame:
    """Maximal runs of consecutive ids per group, as ``lo``/``hi`` rows.

    Ranges are found inside blocks of ``2**bits`` ids, so a group of any size is spread over many tasks.
    Only ranges that reach a block edge (at most two per block) are stitched per group.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(*keys, F.col(id_col).cast("long").alias("_id")).distinct()
    local = (
        ids.withColumn(BLOCK, block_of("_id", bits))
        .withColumn("_island", F.col("_id") - F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy("_id")))
        .groupBy(*keys, BLOCK, "_island")
        .agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
        .select(*keys, "lo", "hi")
    )
    return _stitched(local, keys, bits)


def _stitched(local: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Join ranges that meet at the edge of a block of ``2**bits`` ids."""
    mask = (1 << bits) - 1
    at_edge = (F.col("lo").bitwiseAND(mask) == 0) | (F.col("hi").bitwiseAND(mask) == mask)
    w = Window.partitionBy(*keys).orderBy("lo")
    starts = F.coalesce(F.lag("hi").over(w) < F.col("lo") - 1, F.lit(True))
    stitched = (
        local.where(at_edge)
        .withColumn("_new", starts.cast("long"))
        .withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_chain")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_chain")
    )
    return local.where(~at_edge).unionByName(stitched)


#: Ids of one bitmap: the length of Spark's bitmap aggregates.
BITMAP_BITS = 15
#: Bitmaps whose runs are held in memory at a time.
RUNS_AT_ONCE = 32


def id_bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Sets of ids as ``(keys, bucket, ids)``: one bitmap for every 2^15 ids of a group, built by partial aggregates.

    Such tables are mergeable state: ``merge_bitmaps`` of their union is the set of all ids. NULL keys are keys.
    """
    known = df.where(F.col(id_col).isNotNull()).select(*keys, F.col(id_col).cast("long").alias("_id"))
    bit = F.col("_id").bitwiseAND((1 << BITMAP_BITS) - 1)
    return known.groupBy(*keys, F.shiftright("_id", BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("ids"))


def merge_bitmaps(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def bitmap_size(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many ids each group's set holds."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("ids")).alias("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ones in each bitmap, as first and last bit, a row for each; a few bitmaps at a time, for one may hold 2**14 runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUNS_AT_ONCE):
            part = batch.slice(at, RUNS_AT_ONCE)
            lo, hi, row = [], [], []
            for i, bits in enumerate(part.column("ids")):
                ones = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype=np.uint8), bitorder="little").astype(np.int8)
                edge = np.diff(np.r_[0, ones, 0])
                lo.append(np.flatnonzero(edge == 1))
                hi.append(np.flatnonzero(edge == -1) - 1)
                row.append(np.full(len(lo[-1]), i))
            kept = part.select([c for c in part.schema.names if c != "ids"]).take(pa.array(np.concatenate(row)))
            found = [pa.array(np.concatenate(x).astype(np.int32)) for x in (lo, hi)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "_lo", "_hi"])


def bitmap_ranges(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of consecutive ids per group, as ``lo``/``hi`` rows, read off the words of the bitmaps."""
    bitmaps = sets.select(*keys, "bucket", "ids")
    fields = [f for f in bitmaps.schema.fields if f.name != "ids"]
    each = bitmaps.mapInArrow(_runs, StructType([*fields, StructField("_lo", IntegerType()), StructField("_hi", IntegerType())]))
    base = F.shiftleft("bucket", BITMAP_BITS)
    return _stitched(each.select(*keys, (base + F.col("_lo")).alias("lo"), (base + F.col("_hi")).alias("hi")), keys, BITMAP_BITS)


def range_piece() -> Column:
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    return F.when(F.col("hi") > F.col("lo"), F.concat(lo, F.lit("-"), hi)).otherwise(lo)


def range_text(ranges: DataFrame, keys: Sequence[str], page_bits: int = PAGE_BITS) -> DataFrame:
    """Join ranges to text, one row per group and page of ``2**page_bits`` ids, so no text grows unbounded."""
    return (
        ranges.withColumn("page", F.shiftright("lo", page_bits))
        .withColumn("_piece", range_piece())
        .groupBy(*keys, "page")
        .agg(F.expr("listagg(_piece, ',') within group (order by lo)").alias("ids"))
    )


def folder_ranges(runs: DataFrame, groups: Sequence[str], folder: str = "folder", page_bits: int = PAGE_BITS) -> DataFrame:
    """Run numbers per group as ``6-8,10,12-13[n]``; ``n`` counts duplicates.

    The run number is the folder's base name. If any name in a group is not an integer, the group shows ``0[n]``.
    """
    base = F.substring_index(F.col(folder), "/", -1)
    numbered = runs.dropna(subset=list(groups)).select(*groups, base.try_cast("long").alias("_num"))
    stats = numbered.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("_num").isNull()).alias("_odd")
    )
    odd = stats.where("_odd").withColumn("page", F.lit(0).cast("long")).withColumn("ids", F.lit("0"))
    pages = range_text(id_ranges(numbered, groups, "_num"), groups, page_bits)
    shown = stats.where(~F.col("_odd")).join(pages, list(groups)).unionByName(odd)
    return shown.select(*groups, "page", F.concat("ids", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("folders"), "n")


def compact_ids(df: DataFrame, id_col: str, page_bits: int = PAGE_BITS) -> DataFrame:
    """All ids of a table as ``6-8,10,12-13[n]``, one row per page of ids. No ids give no row."""
    n = df.where(F.col(id_col).isNotNull()).agg(F.count(F.lit(1))).scalar()
    pages = range_text(id_ranges(df, [], id_col), [], page_bits)
    return pages.withColumn("n", n).withColumn(
        "text", F.concat("ids", F.lit("["), F.col("n").cast("string"), F.lit("]"))
    )


def expand_ids(df: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """Rows of ids from ``6-8,10`` texts. A part that is not ``a`` or ``a-b`` is an error; ``9-7`` is empty.

    A range is first cut into pages, which are spread over tasks, so its length is bounded by nothing.
    """
    part = F.trim(F.col("_part"))
    lo = F.regexp_extract(part, r"^(\d+)", 1).cast("long")
    hi = F.when(part.contains("-"), F.regexp_extract(part, r"-(\d+)$", 1).cast("long")).otherwise(lo)
    ids = (
        F.when(~part.rlike(r"^\d+(-\d+)?$"), F.raise_error(F.concat(F.lit("invalid id range: "), part)).cast("array<bigint>"))
        .when(lo <= hi, F.sequence(F.shiftright(lo, EXPAND_BITS), F.shiftright(hi, EXPAND_BITS)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    parts = df.where(F.col(text) != "").withColumn("_part", F.explode(F.split(text, ",")))
    pages = parts.select("*", lo.alias("_lo"), hi.alias("_hi"), F.explode(ids).alias("_page")).repartition("_page")
    first = F.greatest("_lo", F.shiftleft("_page", EXPAND_BITS))
    last = F.least("_hi", F.shiftleft(F.col("_page") + 1, EXPAND_BITS) - 1)
    return pages.withColumn(id_col, F.explode(F.sequence(first, last))).drop("_part", "_lo", "_hi", "_page", text)
