"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so containment of the item in the document counts, not likeness. Items are
partitioned by the number of their shingles. Of an item with q shingles the sketch is its k smallest shingle hashes
(bottom-k MinHash) with k = floor((1 - threshold) * u) + 1, where u is the upper end of the item's size class, or all
q if that is less. A document that holds at least threshold * q of the item's shingles misses at most
floor((1 - threshold) * q) of them, so it must hold one of the sketch: the search loses nothing. Documents probe the
sketches with all their shingles. Only pairs with a sketch hit and a document large enough for the item are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import maybe_broadcast, saved

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def with_shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add 64-bit hashes of all five-word shingles, repeats included; of a shorter text its whole sequence; of none nothing.

    Words and their codes are columns of their own: inside a lambda they would be computed anew for each shingle.
    """
    coded = df.withColumn("_words", tokens(F.col(text))).withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    size = F.size("_codes")
    whole = F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("_codes", size)))
    every = F.transform(F.sequence(F.lit(0), size - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get("_codes", i + k) for k in range(SHINGLE_WORDS)]))
    return coded.withColumn(name, F.when(size < SHINGLE_WORDS, whole).otherwise(every)).drop("_words", "_codes")


def item_sketches(items: DataFrame, item_id: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, h, q, in_sketch): each distinct shingle of each item, its count, and whether the sketch has it."""
    hashed = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")), "_text", "_h")
    shingles = hashed.select("item_id", F.array_sort(F.array_distinct("_h")).alias("_s"))
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_s"))))  # the upper end: sizes in (2**(i-1), 2**i]
    keep = F.floor(F.lit(1 - threshold + 1e-9) * size_class) + 1
    return shingles.where(F.size("_s") > 0).select("item_id", F.size("_s").alias("q"), keep.alias("_k"), F.posexplode_outer("_s").alias("_at", "h")).select(
        "item_id", "h", "q", (F.col("_at") < F.col("_k")).alias("in_sketch")
    )


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every item of which a document holds the threshold.

    ``shared`` counts distinct shingles. NULL and empty texts hold nothing; items without words are in no document;
    an item of fewer than five words is only in a document that has just these words. Repeated rows and rows with one
    id count as one document. Rows with NULL ids are compared as well. Items are broadcast only if their
    shingles, counted first, are few; else both sides are shuffled by shingle.
    """
    sketches = saved(item_sketches(items, item_id, text, threshold), "sketches")
    n = sketches.count()
    hashed = with_shingles(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "_s")
    # explode_outer: for explode, the optimiser filters on the array's size first and computes it twice, word by word
    words = hashed.select("doc_id", F.size("_s").alias("_n"), F.explode_outer("_s").alias("h"))
    hits = words.join(maybe_broadcast(sketches, n), "h").where(F.col("_n") >= F.lit(threshold) * F.col("q"))
    pairs = hits.groupBy("doc_id", "item_id", "q", "h").agg(F.max("in_sketch").alias("in_sketch")).groupBy("doc_id", "item_id", "q").agg(
        F.count(F.lit(1)).alias("shared"), F.max("in_sketch").alias("_candidate")
    )
    found = pairs.where("_candidate").where(F.col("shared") >= F.ceil(F.lit(threshold - 1e-9) * F.col("q")))
    return found.select("doc_id", "item_id", "shared", F.col("q").cast("long").alias("item_shingles"), (F.col("shared") / F.col("q")).alias("containment"))
