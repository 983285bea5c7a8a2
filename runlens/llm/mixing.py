"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt into permuted blocks. A source may be passed twice: the first pass takes blocks
until the target or the end of the source, the second, in an order of its own, the rest. These blocks are the
source's exact quota. The tree then shares all quotas out among the output shards: a node's blocks are split into
two halves by a seeded random draw without replacement, so the number of blocks of each source that goes left is
multivariate hypergeometric, and all quotas stay exact. Inside a shard rows are in a random order.

Blocks are few, so the tree works on a small table; documents are joined to their block once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import WORD, fresh, saved

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
#: Blocks of all sources together, about, up to 2**28 rows; above that a block has BLOCK_ROWS rows.
BLOCKS = 4096
BLOCK_ROWS = 1 << 16
DEPTH = 4
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of a table with one row (source, source_size) for each source.

    Sources by code point, NULL last, take the weights in turn and share ``budget`` times all sizes. A target stops
    at ``most`` times its source's size; the excess is reshared by weight. Sources in the order in which they reach
    their bound (size per weight) show at once which do: no iteration.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(number - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(budget) * F.sum("source_size").over(everything)
    # the share of a unit of weight if this source and all after it are below their bounds
    before_cap, before_w = F.sum("_cap").over(upto) - F.col("_cap"), F.sum("_w").over(upto) - F.col("_w")
    unit = (total - before_cap) / (F.sum("_w").over(everything) - before_w)
    s = s.withColumn("_unit", unit).withColumn("_free", F.col("_unit") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_free"), F.col("_unit")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("_level", level).select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _split(blocks: DataFrame, depth: int, seed: int) -> DataFrame:
    """The tree: at each level every node's blocks are halved by a draw without replacement."""
    node = blocks.withColumn("shard", F.lit(0))
    for level in range(depth):
        drawn = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("source", "block", "pass", F.lit(seed), F.lit(level)), "source", "block", "pass"))
        half = F.count(F.lit(1)).over(Window.partitionBy("shard"))
        node = node.withColumns({"_rank": drawn, "_all": half}).withColumn("shard", 2 * F.col("shard") + F.when(2 * F.col("_rank") > F.col("_all") + F.pmod(F.col("shard"), F.lit(2)), 1).otherwise(0)).drop("_rank", "_all")
    return node


def plan(sized: DataFrame, depth: int = DEPTH, seed: int = SEED, **shares) -> tuple[DataFrame, DataFrame]:
    """Blocks drawn by the mix, and their rows.

    ``sized`` has doc_id, text_hash, source, size. Returns (taken blocks: source, block, pass, shard, quota, whole) and the rows
    with source_size, target and block.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    goal = targets(per_source.select("source", "source_size"), **shares)
    all_rows = per_source.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    rows_each = max(1, min(all_rows // BLOCKS, BLOCK_ROWS))
    sources = saved(goal.join(per_source.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_blocks", F.greatest(F.floor(F.col("_rows") / rows_each), F.lit(1))), "mix-sources")
    of = sources.select(F.col("source").alias("_s"), "source_size", "target", "_blocks")
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = saved(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("_blocks"))).drop("_blocks"), "mix-rows")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    passes = blocks.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "_goal", F.when(F.col("pass") == 1, F.least("target", "source_size")).otherwise(F.greatest(F.col("target") - F.col("source_size"), F.lit(0.0)))
    )
    permuted = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", F.lit(seed), "pass"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passes = passes.withColumn("_upto", F.sum("words").over(permuted)).withColumn("quota", F.col("_goal") - (F.col("_upto") - F.col("words")))
    taken = passes.where("words > 0 and quota > 0").withColumn("whole", F.col("quota") >= F.col("words")).select("source", "block", "pass", "quota", "whole")
    return saved(_split(taken, depth, seed), "mix-blocks"), rows


def draw(taken: DataFrame, rows: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per drawn copy: doc_id, text_hash, source, size, pass, shard, place.

    Whole blocks give all their rows. Of the one block of each source and pass that its quota cuts, rows in random
    order are taken up to the place nearest to the quota. ``place`` sorts a shard into its random order.
    """
    b = taken.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "pass", "shard", "quota", "whole")
    hit = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    whole = rows.join(b.where("whole"), hit)
    part = rows.join(b.where("not whole"), hit)
    order = Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed), "pass", F.lit("part")), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("_upto", F.sum("size").over(order)).where(F.col("_upto") - F.col("size") / 2 <= F.col("quota")).drop("_upto")
    return whole.union(part).withColumn("place", F.xxhash64("doc_id", "text_hash", "pass", "shard", F.lit(seed))).drop("_s", "_b", "quota", "whole", "block")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """The drawn copies, and all rows with size, source_size and target.

    NULL texts have size 0, as other texts without a word; they come with their block and count nothing. A NULL source is a source. Repeated
    rows are drawn each for itself. An empty table gives empty results. Reruns draw the same.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"))
    sized = saved(rows, "mix-sizes")
    taken, rows = plan(sized, **options)
    return draw(taken, rows), rows


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix, a twice-drawn document twice, by shard and in each shard's random order.

    A row is told by its id and text; repeated rows are one row here. The order is laid by ranges of (shard, place),
    so a shard may be any number of tasks.
    """
    row_hash, d_id, d_hash, shard, place = (fresh(docs, f"_{name}") for name in ("row_hash", "drawn_id", "drawn_hash", "shard", "place"))
    own = docs.withColumn(row_hash, F.coalesce(F.xxhash64(text), F.lit(0))).dropDuplicates([doc_id, row_hash])
    drawn, _ = mix(own.select(doc_id, source, text), doc_id, source, text, **options)
    d = drawn.select(F.col("doc_id").alias(d_id), F.col("text_hash").alias(d_hash), F.col("shard").alias(shard), F.col("place").alias(place))
    rows = own.join(d, F.col(doc_id).eqNullSafe(F.col(d_id)) & (F.col(row_hash) == F.col(d_hash)))
    return rows.repartitionByRange(F.col(shard), F.col(place)).sortWithinPartitions(shard, place).select(docs.columns)
