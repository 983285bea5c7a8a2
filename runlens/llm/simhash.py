"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a positional byte index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fresh, saved
from runlens.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Eight bytes of which at most MAX_BITS can differ: so many must be equal.
MIN_BYTES = 8 - MAX_BITS
#: Shingles hashed at a time, so that a very long text needs bounded memory.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of one text; 0 without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII whitespace only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - SHINGLE_WORDS + 1)
    first, last = starts[:n].tolist(), ends[min(SHINGLE_WORDS, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(first[k : k + SHINGLES_AT_ONCE], last[k : k + SHINGLES_AT_ONCE])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a long. Empty and NULL texts get 0."""
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One posting per choice of MIN_BYTES byte positions: the choice and the bytes there make the key."""
    choices = list(combinations(range(8), MIN_BYTES))
    for batch in batches:
        fp = batch["fp"].to_numpy(dtype=np.int64)
        at = np.ascontiguousarray(fp.astype(">i8")).view(np.uint8).reshape(-1, 8).astype(np.int64)
        for number, places in enumerate(choices):
            key = np.full(len(fp), number, dtype=np.int64)
            for p in places:
                key = key << 8 | at[:, p]
            yield pd.DataFrame({"key": key, "fp": fp})


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then the exact distance: pairs with fewer equal positional bytes than guaranteed cannot link."""
    x = np.bitwise_xor(a, b)
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    return (tally >= MIN_BYTES) & (np.bitwise_count(x.view(np.uint64)) <= MAX_BITS)


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect one posting list just as all its links would.

    Each round takes one entry, finds what it links to among all others and merges those. Entries are compared with
    the whole list, so no link between different groups is missed; a group that is already one needs no more rounds
    once every entry outside it has been compared.
    """
    label, out = np.arange(len(fp)), []
    for i in range(len(fp)):
        if (label == label[0]).all():
            break
        other = np.flatnonzero(label != label[i])
        hit = other[_linked(fp[other], np.full(len(other), fp[i]))]
        out += [(int(fp[i]), int(fp[j])) for j in hit]
        for at in np.unique(label[hit]):
            label[label == at] = label[i]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside the posting lists of a partition sorted by key. A list may run over several batches."""
    key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        key = np.r_[key, batch["key"].to_numpy(dtype=np.int64)]
        fp = np.r_[fp, batch["fp"].to_numpy(dtype=np.int64)]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
        yield _list_links(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    yield _list_links(key, fp)


#: Lists up to this length are compared entry by entry, all lists of a batch at once.
SHORT = 32


def _list_links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    length = np.diff(np.r_[first, len(key)])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    member = np.repeat(length <= SHORT, length)
    k, f = key[member], fp[member]
    for shift in range(1, SHORT):
        at = np.flatnonzero(k[shift:] == k[:-shift]) if len(k) > shift else np.empty(0, dtype=np.int64)
        if not len(at):
            break
        at = at[_linked(f[at], f[at + shift])]
        pairs.append((f[at], f[at + shift]))
    for i in np.flatnonzero(length > SHORT):
        found = _forest(fp[first[i] : first[i] + length[i]])
        pairs.append((np.array([x for x, _ in found], dtype=np.int64), np.array([y for _, y in found], dtype=np.int64)))
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what lies at most MAX_BITS bits apart.

    Of eight bytes, MIN_BYTES are equal in any such pair, so the pair meets in at least one posting list of the
    index on MIN_BYTES byte positions. Within a list the shared positional bytes are tallied and the distance is
    verified. Inside a dense list only links that join separate groups are returned.
    """
    postings = prints.select("fp").distinct().mapInPandas(_postings, "key long, fp long")
    return postings.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_links, "a long, b long").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) per row: the smallest id reachable by links between fingerprints.

    ``component`` is the smallest fingerprint of the group. Equal fingerprints are one node, so copies cost nothing
    beyond their row. NULL ids get their group's smallest id, NULL if it has none. Repeated rows stay; an empty table
    gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), F.col(text).alias("_text"))
    prints = saved(fingerprints(rows, "_text").drop("_text"), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    groups = components(links(prints)).withColumnRenamed("node", "fp")
    labelled = least.join(groups, "fp", "left").select("fp", "_least", F.coalesce("component", "fp").alias("component"))
    of_group = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    return prints.join(labelled.join(of_group, "component").drop("_least"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group: the smallest id, NULL last; of one id the smallest text hash. Repeats go."""
    return keep_least(docs, simhash_components(docs, doc_id, text), doc_id, text)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of each ``component`` of ``found`` (with doc_id, text_hash) the rows of its least document."""
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")).alias("_b"))
    keep = best.select(F.col("_b.doc_id").alias("_keep_id"), F.col("_b.text_hash").alias("_keep_hash"))
    own = fresh(docs, "_hash")
    rows = docs.withColumn(own, F.coalesce(F.xxhash64(text), F.lit(0))).dropDuplicates([doc_id, own])
    return rows.join(keep, rows[doc_id].eqNullSafe(keep["_keep_id"]) & (rows[own] == keep["_keep_hash"]), "left_semi").select(docs.columns)
