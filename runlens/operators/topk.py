"""Online top-k admission, in batch over stored series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import blocks
from runlens.operators.blocks import BLOCK, DEFAULT_BITS, block_of
from runlens.operators.keys import join_keys
from runlens.operators.reduce import clean
from runlens.session import cut


def _running_best(rows: DataFrame, k: int, window, names: list[str]) -> DataFrame:
    """Add the k best values of all earlier rows, best first; NULL while there are fewer.

    A chain of running maxima over one sort: what the m-th does not keep is handed to the next, as in insertion.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    carried = "value"
    for m, name in enumerate(names):
        rows = rows.withColumn(name, F.max(carried).over(before))
        # a value better than the m-th best pushes that one down; without one nothing is handed on
        rows = rows.withColumn(f"_carry{m}", F.when(F.col(name).isNotNull(), F.least(F.col(carried), F.col(name))))
        carried = f"_carry{m}"
    return rows.drop(*[f"_carry{m}" for m in range(k)])


def topk_admission(
    points: DataFrame,
    k: int,
    keys: Sequence[str] = ("run_id", "metric"),
    bits: int = DEFAULT_BITS,
    kept_before: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Flag each score that was among the k best when it arrived: fewer than k seen, or it strictly beats the worst kept.

    ``worst`` is the worst kept score it had to beat (NULL while fewer than k are kept). Huge series are cut
    into blocks of positions. The k best scores of each block are enough to know the kept set at the start of
    every block, and that set enters the block as rows before all others. So every block is one sort and k running
    maxima, without Python. ``kept_before(keys, value)`` holds scores kept from earlier data. A NULL key is a series.
    """
    keys = list(keys)
    if k < 1:
        raise ValueError("k must be at least 1")
    names = [f"_best{m}" for m in range(k)]
    rows = points.select(*keys, F.col("pos").cast("long").alias("pos"), clean("value").alias("value")).where("value is not null")
    rows, any_cut = _in_blocks(rows, keys, bits, hot_rows)
    seeds = _entering(rows, k, keys, kept_before, any_cut)
    order = Window.partitionBy(*keys, BLOCK).orderBy("pos")
    seeded = rows.select(*keys, BLOCK, "pos", "value").unionByName(seeds)
    # the order among a block's seeds does not matter: no result is read from them
    out = _running_best(seeded if any_cut or kept_before is not None else rows.select(*keys, BLOCK, "pos", "value"), k, order, names).where("pos >= 0")
    worst = F.col(names[-1])
    return out.select(*keys, "pos", "value", (worst.isNull() | (F.col("value") > worst)).alias("admitted"), worst.alias("worst"))


def _in_blocks(rows: DataFrame, keys: list[str], bits: int, hot_rows: int | None) -> tuple[DataFrame, bool]:
    """Block numbers of huge series, and whether there are any: -1 stands for a series that is not cut, -2 for scores kept earlier.

    Huge series are looked for once, by one count per series; a table without one is neither joined nor cut. Without keys
    a table with no more rows than a huge series has is one series that is not cut.
    """
    most = blocks.HOT_ROWS if hot_rows is None else hot_rows
    whole = F.lit(-1).cast("long")
    if not keys:
        any_cut = rows.limit(most + 1).count() > most
        return rows.withColumn(BLOCK, F.coalesce(block_of("pos", bits), whole) if any_cut else whole), any_cut
    hot = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return rows.withColumn(BLOCK, whole), False
    marked = join_keys(rows, F.broadcast(hot), keys, "left")
    return marked.withColumn(BLOCK, F.coalesce(F.when(F.col("_hot"), block_of("pos", bits)), whole)).drop("_hot"), True


def _entering(rows: DataFrame, k: int, keys: list[str], kept_before: DataFrame | None, any_cut: bool) -> DataFrame:
    """The scores kept when a block begins, as rows ``(keys, block, pos = -1, value)``, from at most k rows of each earlier block."""
    if not any_cut:
        first = F.lit(-1).cast("long")
        none = rows.limit(0).select(*keys, BLOCK, "pos", "value")
        return none if kept_before is None else kept_before.select(*keys, first.alias(BLOCK), first.alias("pos"), F.col("value").cast("double"))
    names = [f"_best{m}" for m in range(k)]
    rank = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(F.desc("value"), "pos"))
    read = rows if kept_before is not None else rows.where(F.col(BLOCK) >= 0)
    best = read.withColumn("_rk", rank).where(F.col("_rk") <= k).select(*keys, BLOCK, "value", "_rk")
    if kept_before is not None:
        best = best.unionByName(kept_before.select(*keys, F.lit(-2).cast("long").alias(BLOCK), F.col("value").cast("double"), F.lit(0).alias("_rk")))
    entered = _running_best(best, k, Window.partitionBy(*keys).orderBy(BLOCK, "_rk", F.desc("value")), names)
    return entered.where((F.col("_rk") == 1) & (F.col(BLOCK) >= -1)).select(
        *keys, BLOCK, F.lit(-1).cast("long").alias("pos"), F.explode(F.array_compact(F.array(*names))).alias("value")
    )


# -- slots ---------------------------------------------------------------------------------------------------------------
#
# The worst kept score never falls, so scores are replaced in the order of their size: of all scores that a block
# starts with or admits, the t-th to be replaced is the t-th smallest, and its slot goes to the t-th score admitted once
# the slots are full. Equal scores are replaced by rising slot. So a slot is found by pointers, from a score to the one it
# replaces, and by sorting the slots of equal scores; no score has to wait for the one before it.


def _first_of_run(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table begins another value of the columns. NULLs are equal."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        s = pd.Series(c)
        new[1:] |= ((s != s.shift()) & ~(s.isna() & s.shift().isna())).to_numpy()[1:]
    return new


def _symbols(group: np.ndarray, seed: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Where each score's slot comes from, for any number of groups at once; a group's seeds come first, then its scores in order.

    A symbol below n is a row: a seed's own slot, or the next free slot. A symbol n + p is what place p of the rows by
    size gives out after the slots of equal scores were sorted. Returns the symbols, the runs of equal scores to be sorted (first place,
    length) level by level, the rows by size, and which of these places are still kept in the end.
    """
    n = len(value)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    begin = np.repeat(start, size)
    seeds = np.repeat(np.add.reduceat(seed, start), size)
    at = np.arange(n) - begin - seeds  # number of a score among the admitted; negative for seeds
    free = np.minimum(k - seeds, np.repeat(size, size) - seeds)
    by_size = np.lexsort((np.arange(n), value, group))
    v = value[by_size]
    first = np.r_[True, (v[1:] != v[:-1]) | (group[1:] != group[:-1])]
    run = np.flatnonzero(first)
    length = np.diff(np.r_[run, n])
    alone = np.repeat(length == 1, length)
    evicts = at >= free
    place = (begin + at - free)[evicts]  # place, by size, of the score that is replaced
    pointer, symbol = np.arange(n), np.arange(n)
    pointer[evicts] = np.where(alone[place], by_size[place], pointer[evicts])
    symbol[evicts] = np.where(alone[place], symbol[evicts], n + place)
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            break
        pointer = further
    replaced = np.repeat(np.add.reduceat(evicts, start), size)
    kept = np.arange(n) - begin >= replaced
    sorted_runs = np.flatnonzero((length > 1) & ~kept[run])
    level = np.arange(len(sorted_runs)) - np.searchsorted(group[run[sorted_runs]], group[run[sorted_runs]])
    levels = [np.stack([run[sorted_runs[level == i]], length[sorted_runs[level == i]]], axis=1) for i in range(level.max(initial=-1) + 1)]
    return symbol[pointer], levels, by_size, kept


def _slots(group: np.ndarray, seed: np.ndarray, value: np.ndarray, slot: np.ndarray, k: int) -> np.ndarray:
    """Slots of the admitted scores of groups whose seeds' slots are known."""
    n = len(value)
    symbol, levels, by_size, _ = _symbols(group, seed, value, k)
    begin = np.searchsorted(group, group)
    given = np.concatenate([np.where(seed, slot, np.arange(n) - begin), np.zeros(n, dtype=np.int64)])
    for runs in levels:
        number = np.repeat(np.arange(len(runs)), runs[:, 1])
        place = np.repeat(runs[:, 0] - np.cumsum(runs[:, 1]) + runs[:, 1], runs[:, 1]) + np.arange(runs[:, 1].sum())
        slots = given[symbol[by_size[place]]]
        given[n + place] = slots[np.lexsort((slots, number))]
    return given[symbol]


def _whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches again, cut only between groups, with the number of each row's group."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        new = _first_of_run(*[rest[c].to_numpy() for c in by])
        last = len(new) - 1 - int(new[::-1].argmax()) if len(new) else 0
        if last:
            yield rest.iloc[:last].reset_index(drop=True), np.cumsum(new[:last]) - 1
            rest = rest.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.cumsum(_first_of_run(*[rest[c].to_numpy() for c in by])) - 1


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches again, cut only where ``_first`` says that a series begins, with these marks."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if len(begins):
            last = int(begins[-1])
            yield from _marked([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    yield from _marked(rest)


def _marked(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        whole = pa.concat_batches(parts)
        yield whole, whole.column("_first").to_numpy(zero_copy_only=False)


def assign_slots(
    admitted: DataFrame, k: int, keys: Sequence[str] = ("run_id", "metric"), kept_before: DataFrame | None = None,
    bits: int = DEFAULT_BITS, hot_rows: int | None = None, few: bool = False,
) -> DataFrame:
    """Slot each admitted score is stored in: slots fill from 0, then the worst one is reused (lowest slot on ties).

    Takes admitted rows only. ``kept_before(keys, slot, value)`` holds the slots as earlier data left them. A huge series is cut into
    blocks: each says where its slots come from in terms of the slots it starts with, these few rows are chained per
    series, and the rows look their slot up. A NULL key is a series. With ``few`` the caller vouches that there is no
    huge series, and none is looked for.
    """
    keys = list(keys)
    rows = admitted.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
    rows, any_cut = (rows.withColumn(BLOCK, F.lit(-1).cast("long")), False) if few else _in_blocks(rows, keys, bits, hot_rows)
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in admitted.select(*keys).schema.fields)
    uncut = rows.where(F.col(BLOCK) == -1).select(*keys, "pos", "value", F.lit(None).cast("int").alias("old_slot"))
    if kept_before is not None:
        uncut = uncut.unionByName(kept_before.select(*keys, F.lit(-1).cast("long").alias("pos"), F.col("value").cast("double"), F.col("slot").cast("int").alias("old_slot")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _whole_series(batches):
            value, old = batch.column("value").to_numpy(zero_copy_only=False), batch.column("old_slot")
            seed = old.is_valid().to_numpy(zero_copy_only=False)
            found = _slots(np.cumsum(first) - 1, seed, value, old.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), k)
            named = [*keys, "pos", "value"]
            slotted = pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], pa.array(found.astype(np.int32))], names=[*named, "slot"])
            yield slotted.filter(pa.array(~seed))

    ordered = uncut.repartition(*keys).sortWithinPartitions(*keys, "pos", "old_slot")
    # the same order again: nothing is sorted twice, and no task has to compare keys
    ordered = ordered.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "old_slot")) == 1)
    out = ordered.mapInArrow(place, f"{key_fields}, pos long, value double, slot int")
    parts = rows.where(F.col(BLOCK) >= 0)
    return out if not any_cut or parts.isEmpty() else out.unionByName(_slots_in_blocks(parts, k, keys, kept_before, key_fields))


def _slots_in_blocks(rows: DataFrame, k: int, keys: list[str], kept_before: DataFrame | None, key_fields: str) -> DataFrame:
    seeded = rows.select(*keys, BLOCK, "pos", "value").unionByName(_entering(rows, k, keys, kept_before, True).where(F.col(BLOCK) >= 0))
    by = [*keys, BLOCK]

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Registers of a block: 0 to k - 1 hold the slots it starts with, then come those of its sorted runs."""
        for pdf, group in _whole_groups(batches, by):
            for _, part in pdf.groupby(group, sort=False):
                seed, value, n = (part["pos"] < 0).to_numpy(), part["value"].to_numpy(), len(part)
                symbol, levels, by_size, kept = _symbols(np.zeros(n, dtype=np.int64), seed, value, k)
                register = np.r_[np.arange(n), np.zeros(n, dtype=np.int64)]
                sorts, top = [], k
                for ((first, length),) in (level.tolist() for level in levels):
                    register[n + first : n + first + length] = top + np.arange(length)
                    sorts.append(register[symbol[by_size[first : first + length]]].tolist())
                    top += length
                own = register[symbol]
                at = np.flatnonzero(kept)
                in_run = {p: n + p for level in levels for f, m in level.tolist() for p in range(f, f + m)}
                last = [int(register[in_run[p]]) if p in in_run else int(own[by_size[p]]) for p in at.tolist()]
                yield part.loc[~seed, [*by, "pos", "value"]].assign(register=own[~seed], sorts=None, kept=None, kept_values=None)
                yield part.iloc[:1][by].assign(pos=None, value=None, register=None, sorts=[sorts], kept=[last], kept_values=[value[by_size[at]].tolist()])

    fields = f"{key_fields}, {BLOCK} long"
    traced = seeded.repartition(*by).sortWithinPartitions(*by, "pos", "value").mapInPandas(
        trace, f"{fields}, pos long, value double, register int, sorts array<array<int>>, kept array<int>, kept_values array<double>"
    )
    traced = cut(traced)
    summary = traced.where("pos is null").select(*by, "sorts", "kept", "kept_values", F.lit(None).cast("int").alias("slot"))
    if kept_before is not None:
        old = kept_before.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("value").cast("double").alias("value"), F.col("slot").cast("int").alias("slot")))).alias("_o"))
        none = F.lit(None).cast("array<array<int>>")
        summary = summary.unionByName(old.select(*keys, F.lit(-2).cast("long").alias(BLOCK), none.alias("sorts"), F.transform("_o", lambda o: o["slot"]).alias("kept"), F.transform("_o", lambda o: o["value"]).alias("kept_values"), F.lit(None).cast("int").alias("slot")))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The registers' slots, block after block; only the slots kept go from one to the next."""
        last, slots = None, []
        for pdf in batches:
            new, out = _first_of_run(*[pdf[c].to_numpy() for c in keys]), []
            if last is not None and len(pdf):
                new[0] = any(a != b and not (pd.isna(a) and pd.isna(b)) for a, b in zip(pdf.iloc[0][keys], last))
            for i, (sorts, kept, values) in enumerate(zip(pdf["sorts"], pdf["kept"], pdf["kept_values"])):
                if new[i]:
                    slots = []
                if sorts is None:  # what earlier data kept
                    held = list(kept)
                else:
                    registers = [*slots, *range(len(slots), k)]
                    for members in sorts:
                        registers += sorted(registers[m] for m in members)
                    held = [registers[r] for r in kept]
                    out.append((i, registers))
                slots = [s for _, s in sorted(zip(values, held))]
            if len(pdf):
                last = tuple(pdf.iloc[-1][keys])
            yield pdf.iloc[[i for i, _ in out]][by].assign(registers=[r for _, r in out])

    found = summary.repartition(*keys).sortWithinPartitions(*by).mapInPandas(chain, f"{fields}, registers array<int>")
    looked_up = join_keys(traced.where("pos is not null").select(*by, "pos", "value", "register"), found, by)
    return looked_up.select(*keys, "pos", "value", F.get("registers", F.col("register")).alias("slot"))


def kept_slots(slotted: DataFrame, keys: Sequence[str] = ("run_id", "metric"), kept_before: DataFrame | None = None) -> DataFrame:
    """What each slot holds in the end: its last write."""
    rows = slotted.select(*keys, "slot", "pos", "value")
    if kept_before is not None:
        rows = rows.unionByName(kept_before.select(*keys, "slot", F.lit(-1).cast("long").alias("pos"), "value"))
    return rows.groupBy(*keys, "slot").agg(F.max_by("value", "pos").alias("value"))
