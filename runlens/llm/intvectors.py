"""Vectors as whole numbers, for operators whose sums must not depend on the order of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are counted in units of 1 / SCALE.
SCALE = 1024


def sound_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, components) of a batch: where each row's vector starts, and its length; 0 for unsound ones.

    Unsound are vectors that are NULL or empty or hold NULL, NaN or infinite components.
    """
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    start = np.cumsum(length) - length
    bad = np.cumsum(np.r_[0, ~np.isfinite(values)])
    return np.where(bad[start + length] == bad[start], length, 0), start, values


def whole(values: np.ndarray, bound: int) -> np.ndarray:
    """floor(1024 * c) of each component; beyond ``bound`` on either side it is the bound."""
    return np.floor(np.clip(values * SCALE, -bound, bound)).astype(np.int64)


def rows_of(column: pa.ListArray, width: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole-numbered vectors) of the sound vectors of one length."""
    length, start, values = sound_rows(column)
    keep = np.flatnonzero(length == width)
    if len(keep) * width == len(values):
        return keep, whole(values, bound).reshape(-1, width)
    return keep, whole(values[start[keep][:, None] + np.arange(width)], bound)


def _whole_rows(embedding: str, width: int, bound: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = rows_of(batch.column(embedding), width, bound)
            others = [c for c in batch.schema.names if c != embedding]
            rows = pa.array(keep)
            x_column = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * width, pa.array(x.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in others], x_column], names=[*others, "x"])

    return run


def whole_rows(vectors: DataFrame, embedding: str, width: int, bound: int) -> DataFrame:
    """The sound vectors of one length as ``x`` array<int>, beside the other columns. ``bound`` must fit an int."""
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != embedding)
    return vectors.mapInArrow(_whole_rows(embedding, width, bound), f"{base}, x array<int>")


def _lengths(embedding: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for d, n in zip(*np.unique(sound_rows(batch.column(embedding))[0], return_counts=True)):
                found[int(d)] = found.get(int(d), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"d": list(found), "n": list(found.values())}, schema=pa.schema([("d", pa.int64()), ("n", pa.int64())]))

    return run


def commonest(lengths: DataFrame) -> int | None:
    """The length of most sound vectors from partial counts (d, n), the longer one of equally common ones."""
    most = lengths.where("d > 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return most[0]["d"] if most else None


def common_length(vectors: DataFrame, embedding: str) -> int | None:
    return commonest(vectors.select(embedding).mapInArrow(_lengths(embedding), "d long, n long"))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column whose lists are all ``width`` long, as rows of a matrix."""
    return np.asarray(batch.column(name).flatten()).astype(np.int64, copy=False).reshape(-1, width)
