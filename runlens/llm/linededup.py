"""Substring dedup by paragraph hashing: of every normalised paragraph the earliest document keeps it, the others lose it.

Line breaks do not line up where a passage is copied into other text, so paragraphs begin where the text itself says:
at the first word and after every word whose letters' codes call for a cut, about every fourth. A paragraph is the
PARAGRAPH words from there on, in lower case and with white space taken as one; a passage that stands in two documents
holds the same paragraphs in both, whatever surrounds it. Their digests are grouped over the whole corpus by a
partial aggregate that keeps the earliest document and tells whether there are others. Only digests of several documents meet
the paragraphs again. Neighbouring and overlapping paragraphs that go are one span of the original text.

With ``every`` a paragraph begins at every word, so that no repeated passage of PARAGRAPH words is missed. Not all of
them need a row. The least digest of the runs of words half as long inside a paragraph is its anchor. Equal paragraphs
have equal anchors, and neighbours mostly share theirs, so a row holds a stretch of paragraphs with one anchor. Only
stretches whose anchor several documents hold go on. Where all stretches of an anchor read the same, the earliest
document keeps them whole; only where they differ are their paragraphs compared one by one, once for each reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import WORD, discard, fresh, saved

#: Words of a paragraph. Passages from some ten words more are met almost surely, shorter ones than this never.
PARAGRAPH = 40
#: A paragraph begins after one word in so many.
CUT = 4
#: Digests with more than this share of all paragraphs, so at most its reciprocal, are joined by a broadcast.
HOT_SHARE = 1e-5
#: Words whose digests a task works on at once; a longer text is taken alone.
CHUNK = 1 << 18
#: A word with the white space before it.
PIECE = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++")


def _cuts(word: Column) -> Column:
    """Whether a paragraph begins after this word."""
    return (F.ascii(word) + 3 * F.ascii(F.right(word, F.lit(1))) + F.length(word)) % CUT == 0


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD})"), F.lit(1))


def _version(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0)).alias("version")


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join on keys counted in ``n``, of ``total`` rows. A key of very many rows is not dealt to one task."""
    hot = keys.where(F.col("n") > total * HOT_SHARE).drop("n")
    cold = keys.where(F.col("n") <= total * HOT_SHARE).drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(cold, on))


def paragraphs_of(docs: DataFrame, doc_id: str, text: str, size: int = PARAGRAPH) -> DataFrame:
    """(doc_id, version, at, h1, h2): first word and digest of each paragraph. ``version`` tells texts of one id apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _version(text), _words(text).alias("_w")).where(F.size("_w") >= size)
    marked = rows.withColumns({"_c": F.transform("_w", _cuts), "_h": F.transform("_w", lambda w: F.xxhash64(w))})
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - size), lambda i: (i == 0) | F.get("_c", i - 1))
    each = marked.select("doc_id", "version", "_h", F.explode(starts).alias("at"))
    piece = F.slice("_h", F.col("at") + 1, F.lit(size))
    return each.select("doc_id", "version", "at", F.xxhash64(piece).alias("h1"), F.hash(piece).alias("h2"))


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = PARAGRAPH) -> DataFrame:
    """(doc_id, version, gone, kept_doc_ids): first words of the paragraphs that an earlier document holds, and these documents' ids.

    Documents rank by id; rows of one id are one document, NULL ids rank last.
    """
    units = saved(paragraphs_of(docs, doc_id, text, size), "paragraphs")
    all_units = units.count()
    seen = units.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("doc_id").alias("_ids"), F.count(F.lit(1)).alias("n"))
    first = saved(seen.where("first < _last or (first is not null and _ids < n)").select("h1", "h2", "first", "n"), "repeated-paragraphs")
    later = _meet(units, first, ["h1", "h2"], all_units).where("doc_id is null or doc_id > first")
    return later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("at")).alias("gone"), F.sort_array(F.collect_set("first")).alias("kept_doc_ids"))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A digest of two 64-bit digests in order."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _digests(words: np.ndarray, size: int) -> np.ndarray:
    """Digest of the ``size`` words from each word on, joined of blocks that double."""
    out, length, block, n = None, 0, words, 1
    while True:
        if size & n:
            out = block if out is None else _mix(out[: len(words) - length - n + 1], block[length:])
            length += n
        if length == size:
            return out
        block, n = _mix(block[:-n], block[n:]), 2 * n


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` values from each on."""
    n = 1
    while 2 * n <= size:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return np.minimum(values[: len(values) - (size - n)], values[size - n :])


def _steps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, digests of their words, where each row's words start and the last's end), some CHUNK words at a time."""
    for batch in batches:
        ends = batch.column("words").offsets.to_numpy().astype(np.int64)
        values = batch.column("words").values.to_numpy(zero_copy_only=False).view(np.uint64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK, "right")) - 1)
            yield batch.slice(low, high - low), values[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
            low = high


def _find_stretches(size: int, names: list[str]):
    half = (size + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, ends in _chunks(batches):
            number = np.diff(ends) - size + 1
            row, at = np.repeat(np.arange(len(number)), number), _steps(number)
            here = ends[row] + at
            anchor, digest = _least(_digests(words, half), size - half + 1)[here], _digests(words, size)[here]
            starts = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
            length = np.diff(np.append(starts, len(at)))
            reading = _mix(np.add.reduceat(_mix(digest, _steps(length).astype(np.uint64)), starts), length.astype(np.uint64))
            own = rows.select(["doc_id", "version"]).take(pa.array(row[starts]))
            columns = [*own.columns, at[starts].astype(np.int32), length.astype(np.int32), anchor[starts].view(np.int64), reading.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    return run


def _find_paragraphs(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, ends in _chunks(batches):
            lists = rows.column("stretches")
            wanted, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            low, length, anchor, reading, least = wanted.flatten()
            low, length = low.to_numpy(), length.to_numpy()
            which, at = np.repeat(np.arange(len(length)), length), _steps(length)
            digest = _digests(words, size)[(ends[row] + low)[which] + at]
            picked = pa.array(which)
            columns = [anchor.take(picked), reading.take(picked), pa.array(at.astype(np.int32)), pa.array(digest.view(np.int64)), least.take(picked)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _by_words(docs: DataFrame, size: int, find, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """What ``find`` finds in texts of a paragraph or more, whose words reach it as digests."""
    digests = F.transform(_words("text"), lambda w: F.xxhash64(w)).alias("words")
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    rows = docs.select(*(c for c in docs.columns if c != "text"), digests).where(F.size("words") >= size)
    return rows.mapInArrow(find(size, schema.names), schema)


def stretches_of(docs: DataFrame, doc_id: str, text: str, size: int = PARAGRAPH) -> DataFrame:
    """(doc_id, version, low, length, anchor, reading): stretches of paragraphs with one anchor, by first words; a paragraph begins at every word.

    ``reading`` is a digest of the stretch's paragraphs in order.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _version(text), F.col(text).alias("text"))
    fields = [("doc_id", rows.schema["doc_id"].dataType), ("version", T.LongType()), ("low", T.IntegerType()), ("length", T.IntegerType()), ("anchor", T.LongType()), ("reading", T.LongType())]
    return _by_words(rows, size, _find_stretches, fields)


def repeated_everywhere(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = PARAGRAPH) -> DataFrame:
    """As ``repeated_paragraphs``, of the paragraphs that begin at every word.

    Of many neighbours that go, ``gone`` lists as many as cover the same words.
    """
    twice = "first < last or (first is not null and ids < n)"
    counts = [F.max("least").alias("last"), F.count("least").alias("ids"), F.count(F.lit(1)).alias("n")]
    stretches = saved(stretches_of(docs, doc_id, text, size), "stretches")
    seen = stretches.withColumn("least", F.col("doc_id")).groupBy("anchor").agg(F.min("least").alias("first"), *counts, (F.min("reading") != F.max("reading")).alias("differ"))
    anchors = saved(seen.where(twice).select("anchor", "first", "n", "differ"), "anchors")
    met = saved(_meet(stretches, anchors, ["anchor"], stretches.count()), "met-stretches")
    discard(docs.sparkSession, stretches)

    # one document of each reading is read again
    differ = met.where("differ").drop("first", "differ")
    one = [F.first(c).alias(c) for c in ("doc_id", "version", "low", "length")]
    readings = saved(differ.groupBy("anchor", "reading").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *one), "readings")
    wanted = readings.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_of")).agg(F.collect_list(F.struct("low", "length", "anchor", "reading", "least")).alias("stretches"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _version(text), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_of"))).select("text", "stretches")
    fields = [("anchor", T.LongType()), ("reading", T.LongType()), ("at", T.IntegerType()), ("h", T.LongType()), ("least", readings.schema["least"].dataType)]
    units = saved(_by_words(rows, size, _find_paragraphs, fields), "paragraphs")
    shared = saved(units.groupBy("anchor", "h").agg(F.min("least").alias("first"), *counts).where(twice).select("anchor", "h", "first", "n"), "shared-paragraphs")
    earlier = _meet(units, shared, ["anchor", "h"], units.count()).where("least is null or least > first")
    earlier = earlier.groupBy("anchor", "reading").agg(F.collect_set(F.struct("at", "first")).alias("earlier"))
    found = saved(readings.select("anchor", "reading", "least", "n").join(earlier, ["anchor", "reading"], "left"), "compared")
    discard(docs.sparkSession, units)

    alike = met.where("not differ").select("doc_id", "version", "low", "length", F.col("first").alias("least"), F.lit(None).cast(found.schema["earlier"].dataType).alias("earlier"))
    each = alike.unionByName(_meet(differ, found, ["anchor", "reading"], differ.count()).select(*alike.columns))
    each = each.withColumn("earlier", F.coalesce("earlier", F.array().cast(found.schema["earlier"].dataType)))
    later = F.expr("least is not null and (doc_id is null or doc_id > least)")
    high = F.col("low") + F.col("length") - 1
    whole = F.array_union(F.sequence("low", high, F.lit(size)), F.array(high))
    at = F.when(later, whole).otherwise(F.transform("earlier", lambda e: F.col("low") + e["at"]))
    rest = F.when(later & (F.size("earlier") < F.col("length")), F.array("least"))
    ids = F.array_union(F.transform("earlier", lambda e: e["first"]), F.coalesce(rest, F.array().cast(T.ArrayType(alike.schema["least"].dataType))))
    each = each.select("doc_id", "version", at.alias("at"), ids.alias("ids")).where(F.size("at") > 0)
    gone = F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("gone")
    return each.groupBy("doc_id", "version").agg(gone, F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("kept_doc_ids"))


def spans_of(text: str, gone, size: int) -> tuple[str, list[int], list[int]]:
    """(text without the paragraphs, where the removed spans start, how long they are) in code points.

    A span is whole words, each with the white space before it.
    """
    ends = [0, *(m.end() for m in PIECE.finditer(text))]
    kept, start, length, at = [], [], [], 0
    for word in gone:
        low, high = ends[word], ends[word + size]
        if start and low <= at:
            length[-1] += max(0, high - at)
        else:
            kept.append(text[at:low])
            start.append(low)
            length.append(high - low)
        at = max(at, high)
    return "".join(kept) + text[at:], start, length


def _cut(size: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            rows = [(None, [], []) if t is None or g is None else spans_of(t, g, size) for t, g in zip(texts, gone)]
            yield pd.DataFrame(rows, columns=["text", "start", "length"])

    return run


def dedup_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = PARAGRAPH, every: bool = False) -> DataFrame:
    """Every row with its kept ``clean_text``, the ``removed`` spans and ``kept_doc_ids``, the documents that keep the paragraphs.

    Paragraphs begin where the text says so, about after one word in CUT, or with ``every`` at every word: then any
    ``size`` words on end that an earlier document holds are removed.

    Spans are offset and length in code points of the original text. NULL texts stay NULL; texts of fewer words than a
    paragraph have nothing to remove; texts of any length are read whole. Repeats inside one document stay, and
    so do repeats among rows of one id or without an id. A document of which nothing stays has an empty text. Columns named as
    the results are replaced, all others are kept, whatever their names. An empty table gives an empty result. Only
    texts that change pass through Python.
    """
    gone = (repeated_everywhere if every else repeated_paragraphs)(docs, doc_id, text, size)
    base = docs.drop("clean_text", "removed", "kept_doc_ids")
    own, other_id, other_version, starts, cut = (fresh(base, n) for n in ("_version", "_gone_id", "_gone_version", "_gone", "_cut"))
    gone = gone.select(F.col("doc_id").alias(other_id), F.col("version").alias(other_version), F.col("gone").alias(starts), "kept_doc_ids")
    base = base.withColumn(own, F.coalesce(F.xxhash64(text), F.lit(0)))
    joined = base.join(gone, F.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other_version)), "left")
    removal = F.pandas_udf(_cut(size), "text string, start array<long>, length array<long>")
    done = joined.withColumn(cut, removal(F.when(F.col(starts).isNotNull(), F.col(text)), F.col(starts)))
    return done.withColumns({
        "clean_text": F.when(F.col(starts).isNull(), F.col(text)).otherwise(F.col(f"{cut}.text")),
        "removed": F.arrays_zip(F.col(f"{cut}.start").alias("start"), F.col(f"{cut}.length").alias("length")),
        "kept_doc_ids": F.coalesce("kept_doc_ids", F.array().cast(gone.schema["kept_doc_ids"].dataType)),
    }).drop(own, other_id, other_version, starts, cut)
