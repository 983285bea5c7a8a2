"""Vector code compression: product quantisation in whole numbers, with norm-of-sum bounds.

Vectors are cut into parts; each part position has a codebook that Lloyd's rounds improve. A vector carries, for each
part, its entry with the distance when it was last computed, and for each group of entries a lower bound on the
distance to any other entry of the group; each of these with the round it dates from. The codebooks of all rounds are
kept, so what an old bound is worth now is told by the net displacement of the entries since its own round (the norm
of the sum of their moves), which is never more than the sum of the moves' norms. Only groups whose bound does not
exceed the distance to the present entry are scanned again, exactly; ties count as not excluded.

Assignment is a pass over the written state of the round before; entry sums are partial per task and merged by Spark.
Codebooks (entries x length, whatever the rows) are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import discard, maybe_broadcast, saved
from runlens.llm.intvectors import common_length, matrix, whole_rows

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Groups of neighbouring entries that share a lower bound.
GROUPS = 16
#: Rows compared at a time.
ROWS_AT_ONCE = 2048
#: Labels with more than this share of the rows are joined by a broadcast of their (few) sums.
HOT_SHARE = 1e-4


@dataclass
class Codebooks:
    """Entries of every part position in every round so far: ``history[round][part]`` is entries x components."""

    cuts: list[tuple[int, int]]
    history: list[list[np.ndarray]]
    groups: int = GROUPS

    @property
    def round(self) -> int:
        return len(self.history) - 1

    @property
    def entries(self) -> int:
        return len(self.history[0][0])

    def group_of(self) -> np.ndarray:
        return np.arange(self.entries) * min(self.groups, self.entries) // self.entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for part in self.history[-1] for entry in part for c in entry).encode()).hexdigest()


def bound_for(width: int) -> int:
    """Components are cut off here, so that every error of a vector fits 63 bits."""
    return math.isqrt(((1 << 63) - 1) // (4 * width))


def cuts_of(width: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal where the length allows; else the first ones are longer by one."""
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances. Doubles hold them below 2^53, beyond that whole numbers are subtracted first."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are never larger."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _moves(books: Codebooks, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Net displacement of each entry from each earlier round to now, and the largest one within each group."""
    now, of = books.history[-1][part].astype(np.float64), books.group_of()
    moved = np.stack([np.linalg.norm(now - old[part], axis=1) for old in books.history]) * (1 + 1e-12)
    widest = np.stack([moved[:, of == g].max(axis=1) for g in range(of[-1] + 1)], axis=1)
    return moved, widest


def _group_bounds(squares: np.ndarray, of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance to the nearest entry of each group but the own one."""
    other = squares.astype(np.float64)
    other[np.arange(len(own)), own] = np.inf
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return np.sqrt(np.minimum.reduceat(other, starts, axis=1))


@dataclass
class State:
    """Of some rows and one part: entry, its squared distance and round, and the groups' lower bounds and rounds."""

    code: np.ndarray
    square: np.ndarray
    since: np.ndarray
    low: np.ndarray
    low_since: np.ndarray


def first_state(x: np.ndarray, books: Codebooks, part: int) -> State:
    squares, of = _squares(x, books.history[-1][part]), books.group_of()
    code = squares.argmin(axis=1)
    low = _down(_group_bounds(squares, of, code))
    now = np.full(len(x), books.round, dtype=np.int8)
    return State(code, squares[np.arange(len(x)), code], now, low, np.repeat(now[:, None], low.shape[1], axis=1))


def next_state(x: np.ndarray, s: State, books: Codebooks, part: int) -> tuple[State, int]:
    """The state in the present round, and how many distances were computed."""
    now, of, entries = books.round, books.group_of(), books.history[-1][part]
    moved, widest = _moves(books, part)
    rows = np.arange(len(x))
    groups = np.arange(widest.shape[1])
    upper = (np.sqrt(s.square) + moved[s.since, s.code]) * (1 + 1e-9)
    low = s.low - widest[s.low_since, groups]
    open_rows = np.flatnonzero((low <= upper[:, None]).any(axis=1))
    code, square, since, kept, kept_since = s.code.copy(), s.square.copy(), s.since.copy(), s.low.copy(), s.low_since.copy()
    scanned = len(open_rows)
    if not len(open_rows):
        return State(code, square, since, kept, kept_since), scanned
    y, old = x[open_rows], s.code[open_rows]
    square[open_rows] = ((y - entries[old]) ** 2).sum(axis=1)
    since[open_rows] = now
    own = square[open_rows]
    need = low[open_rows] <= (np.sqrt(own) * (1 + 1e-9))[:, None]
    best, best_square = old.copy(), own.copy()
    nearest = {}
    for g in groups:
        at = np.flatnonzero(need[:, g])
        if not len(at):
            continue
        members = np.flatnonzero(of == g)
        d = _squares(y[at], entries[members])
        scanned += d.size
        first = d.argmin(axis=1)
        nearest[g] = at, d, members
        candidate, distance = members[first], d[np.arange(len(at)), first]
        better = (distance < best_square[at]) | ((distance == best_square[at]) & (candidate < best[at]))
        best[at[better]], best_square[at[better]] = candidate[better], distance[better]
    code[open_rows], square[open_rows] = best, best_square
    for g, (at, d, members) in nearest.items():
        other = d.astype(np.float64)
        mine = of[best[at]] == g
        other[np.flatnonzero(mine), best[at][mine] - members[0]] = np.inf
        kept[open_rows[at], g] = _down(np.sqrt(other.min(axis=1)))
        kept_since[open_rows[at], g] = now
    # a group that was not scanned but has lost the own entry: that entry now counts for its bound
    lost = np.flatnonzero((best != old) & ~need[np.arange(len(old)), of[old]])
    if len(lost):
        r, g = open_rows[lost], of[old[lost]]
        kept[r, g] = _down(np.minimum(low[r, g], np.sqrt(own[lost])))
        kept_since[r, g] = now
    return State(code, square, since, kept, kept_since), scanned


STATE = "code binary, square array<long>, since binary, low binary, low_since binary, scanned long"


def _assign(books: Codebooks, first: bool) -> Callable:
    """Add or renew the state columns of each row."""
    width, parts = books.cuts[-1][1], len(books.cuts)
    groups = int(books.group_of()[-1]) + 1
    kinds = {"code": np.int16, "since": np.int8, "low": np.float32, "low_since": np.int8}

    def read(batch: pa.RecordBatch, name: str, per_row: int) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kinds[name]).reshape(-1, per_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                x = matrix(batch, "x", width)
                made, scanned = [], 0
                if not first:
                    code, since = read(batch, "code", parts).astype(np.int64), read(batch, "since", parts)
                    low, low_since = read(batch, "low", parts * groups), read(batch, "low_since", parts * groups)
                    square = matrix(batch, "square", parts)
                for p, (a, b) in enumerate(books.cuts):
                    if first:
                        made.append(first_state(x[:, a:b], books, p))
                        scanned += len(x) * books.entries
                    else:
                        g = slice(p * groups, (p + 1) * groups)
                        state, count = next_state(x[:, a:b], State(code[:, p], square[:, p], since[:, p], low[:, g], low_since[:, g]), books, p)
                        made.append(state)
                        scanned += count
                out = {
                    "code": np.stack([s.code for s in made], axis=1).astype(np.int16), "since": np.stack([s.since for s in made], axis=1).astype(np.int8),
                    "low": np.concatenate([s.low for s in made], axis=1).astype(np.float32), "low_since": np.concatenate([s.low_since for s in made], axis=1).astype(np.int8),
                }
                packed = {n: pa.array([r.tobytes() for r in np.ascontiguousarray(v)], pa.binary()) for n, v in out.items()}
                packed["square"] = pa.array(list(np.stack([s.square for s in made], axis=1).astype(np.int64)), pa.list_(pa.int64()))
                packed["scanned"] = pa.array([scanned] + [0] * (len(x) - 1), pa.int64())
                keep = [c for c in batch.schema.names if c not in packed]
                names = ["code", "square", "since", "low", "low_since", "scanned"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[packed[n] for n in names]], names=[*keep, *names])

    return run


def _entry_sums(books: Codebooks) -> Callable:
    """Per task: count and component sums of the parts of each entry that has any."""
    width, parts = books.cuts[-1][1], len(books.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, books.entries), dtype=np.int64)
        sums = [np.zeros((books.entries, b - a), dtype=np.int64) for a, b in books.cuts]
        for batch in batches:
            x = matrix(batch, "x", width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.int16).reshape(-1, parts)
            for p, (a, b) in enumerate(books.cuts):
                counts[p] += np.bincount(code[:, p], minlength=books.entries)
                np.add.at(sums[p], code[:, p], x[:, a:b])
        used = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
        rows = {"part": [p for p, _ in used], "entry": [e for _, e in used], "n": [int(counts[p][e]) for p, e in used], "total": [sums[p][e].tolist() for p, e in used]}
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    return run


def moved_entries(state: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """The next codebooks: floor(sum / count) of the parts assigned to each entry; unused entries stay."""
    partial = state.select("x", "code").mapInArrow(_entry_sums(books), "part int, entry int, n long, total array<long>")
    each = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "t"))
    merged = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    out = [b.copy() for b in books.history[-1]]
    for r in merged.collect():
        out[r["part"]][r["entry"], r["at"]] = int(r["t"]) // r["n"]
    return out


def fit_codes(rows: DataFrame, order: list, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, Codebooks]:
    """The final state of ``rows`` (whole-numbered ``x``) and the codebooks; the first ``entries`` rows by ``order`` start them."""
    spark = rows.sparkSession
    start = np.array([r["x"] for r in rows.orderBy(*order).select("x").limit(entries).collect()], dtype=np.int64)
    cuts = cuts_of(width, parts)
    books = Codebooks(cuts, [[start[:, a:b] for a, b in cuts]], groups)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    state = saved(rows.mapInArrow(_assign(books, True), f"{base}, {STATE}"), "codes-0")
    for k in range(rounds):
        books = Codebooks(cuts, [*books.history, moved_entries(state, books)], groups)
        after = saved(state.mapInArrow(_assign(books, False), f"{base}, {STATE}"), f"codes-{k + 1}")
        discard(spark, state)
        state = after
    return state, books


def _final_squares(books: Codebooks) -> Callable:
    """Squared distance of each vector to its entries, over all parts."""
    width, parts = books.cuts[-1][1], len(books.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.int16).reshape(-1, parts)
            error = np.zeros(len(x), dtype=np.int64)
            for p, (a, b) in enumerate(books.cuts):
                error += ((x[:, a:b] - books.history[-1][p][code[:, p]]) ** 2).sum(axis=1)
            keep = [c for c in batch.schema.names if c not in ("x", "code")]
            text = pa.array(["".join(f"{c:02x}" for c in r) for r in code.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], text, pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    return run


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each sound vector.

    Dropped are vectors that are NULL, empty or hold NULL or non-finite components, and those of another length than
    the commonest (of equally common lengths the longer counts). The codebooks start with the rows of the smallest
    ids, NULL ids last, equal ids by vector, fewer if there are fewer rows. A length that does not divide by four makes the first parts
    longer by one. Components are cut off where squared distances would leave 63 bits; a ``label_error`` beyond them is
    NULL. Repeated rows stay, further columns are not read, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (vec_id, label))
    width = common_length(vectors, embedding)
    if width is None:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = saved(whole_rows(named, "embedding", width, bound_for(width)), "whole-vectors")
    state, books = fit_codes(rows, [F.col("vec_id").asc_nulls_last(), F.col("x")], width)
    discard(spark, rows)
    errors = saved(
        state.select("vec_id", "label", "x", "code").mapInArrow(_final_squares(books), f"vec_id {id_type}, label {label_type}, code string, error long"), "code-errors"
    )
    discard(spark, state)
    return with_label_error(errors).withColumn("codebooks_sha256", F.lit(books.digest())).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def with_label_error(errors: DataFrame) -> DataFrame:
    """Add the error summed over equal labels. Labels of many rows are few and broadcast; the others meet by a shuffle."""
    totals = saved(
        errors.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
        .select(F.col("label").alias("_label"), F.col("total").try_cast("long").alias("label_error"), "n"), "label-errors"
    )
    size = totals.agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    if size["labels"] <= 1 / HOT_SHARE:
        return errors.join(maybe_broadcast(totals.drop("n"), size["labels"]), same).drop("_label")
    hot = totals.where(F.col("n") > size["rows"] * HOT_SHARE).drop("n")
    rest = totals.where(F.col("n") <= size["rows"] * HOT_SHARE).drop("n")
    cold = errors.join(F.broadcast(hot), same, "left_anti")
    return errors.join(F.broadcast(hot), same).unionByName(cold.join(rest, same)).drop("_label")
