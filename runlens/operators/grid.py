"""Parameter grids and their split into groups.

A grid is enumerated by number: ``spark.range(N)`` gives the trial numbers and each option value is read off
as a digit of the number in mixed radix. No join is needed and the rows spread evenly over tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.blocks import dense_positions



def pick(values: Sequence, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


#: Grid cells that one row is expanded to at a time.
GRID_BITS = 16


def _order_block(df: DataFrame, name: str) -> Column:
    """A coarsening of a column's order, for numbering its values in blocks."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return F.substring(name, 1, 4)
    if isinstance(kind, T.IntegralType):
        return F.shiftright(c.cast("long"), 12)
    if isinstance(kind, T.DateType):
        return F.shiftright(F.unix_date(c), 8)
    if isinstance(kind, T.NumericType):
        return F.floor(c.cast("double") / 1024)
    return F.lit(0)


def observed_axis(df: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct non-null values of a column with their number in the sort order, as a table of any length."""
    values = df.where(F.col(name).isNotNull()).select(name).distinct()
    return dense_positions(values, [], [name], _order_block(df, name), position)


def listed_axis(spark: SparkSession, df: DataFrame, name: str, choices: Sequence, position: str) -> DataFrame:
    schema = T.StructType([T.StructField(name, df.schema[name].dataType), T.StructField(position, T.LongType())])
    return spark.createDataFrame([(v, i) for i, v in enumerate(choices)], schema)


def axes_grid(axes: dict[str, DataFrame], number: str = "trial_id") -> DataFrame:
    """Every combination of the values of some axis tables ``(name, _at_<name>)``; the last axis varies fastest.

    ``_n_<name>`` tells the axis' length. Sizes are counted in the query itself. Cells are a range of numbers, laid out
    in pieces that spread over tasks; each axis' value is read off by an equi-join on its digit of the number.
    """
    names = list(axes)
    counts = None
    for name, axis in axes.items():
        one = axis.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("axis"), "n")
        counts = one if counts is None else counts.unionByName(one)
    sizes = counts.agg(*[F.max(F.when(F.col("axis") == name, F.col("n"))).alias(f"_n_{name}") for name in names])
    total = F.lit(1).cast("long")
    for name in names:
        total = total * F.col(f"_n_{name}")
    pieces = sizes.withColumn("_total", total).where("_total > 0").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_total") - 1, GRID_BITS))))
    last = F.least(F.col("_total"), F.shiftleft(F.col("_piece") + 1, GRID_BITS)) - 1
    grid = pieces.repartition("_piece").withColumn(number, F.explode(F.sequence(F.shiftleft("_piece", GRID_BITS), last))).drop("_piece", "_total")
    rest = F.col(number)
    for name in reversed(names):
        grid = grid.withColumn(f"_at_{name}", rest % F.col(f"_n_{name}"))
        rest = F.call_function("div", rest, F.col(f"_n_{name}"))
    for name in names:
        grid = grid.join(axes[name], f"_at_{name}")
    return grid


# One token of a sweep command; a `{...}` value may hold spaces; abbreviation limit.
TOKEN = r"([^\s]+=\{.*\}|[^\s]+)"
MAX_ABBR = 20


def parse_command(command: str, resolved: dict[str, Sequence[str]] | None = None) -> dict[str, list[str] | None]:
    """Options of a sweep command ``./x --iter=100 --seed=1,2``. Plain words map to None.

    A ``{...}`` value is not run in a shell; pass its values in ``resolved`` by option name.
    """
    options: dict[str, list[str] | None] = {}
    for token in re.findall(TOKEN, command):
        name, eq, value = token.partition("=")
        if not eq:
            options[token] = None
        elif resolved and name in resolved:
            options[name] = [str(v).strip() for v in resolved[name]]
        elif value.startswith("{") and value.endswith("}"):
            raise ValueError(f"give the values of {name} in resolved")
        else:
            options[name] = [v.strip() for v in value.split(",")]
    return options


def param_grid(spark: SparkSession, options: dict[str, Sequence[str] | DataFrame | None], target_dir: str | None = None) -> DataFrame:
    """One row per combination: the command line and a label naming only the options that list several values.

    The values of an option are a list, or a table ``(value, at)`` of values and their numbers from 0, of any length. Empty
    values are dropped from a list. A value of 20 or more characters is abbreviated to its index in the label.
    """
    axes, parts, labels = {}, [], []
    for i, (name, values) in enumerate(options.items()):
        if values is None:
            parts.append(F.lit(name))
            continue
        axis, short = f"o{i}", f"_short{i}"
        if not isinstance(values, DataFrame):
            several = F.lit(len(values) > 1)
            rows = [(v, at, j) for at, (j, v) in enumerate((j, v) for j, v in enumerate(values) if v != "")]
            table = spark.createDataFrame(rows, "value string, at long, place long")
        else:
            several = F.col(f"_n_{axis}") > 1
            table = values.select(F.col("value").cast("string").alias("value"), "at", F.col("at").alias("place"))
        brief = F.when(F.length("value") < MAX_ABBR, F.col("value")).otherwise(F.col("place").cast("string"))
        axes[axis] = table.select(F.col("at").cast("long").alias(f"_at_{axis}"), F.concat(F.lit(f"{name}="), "value").alias(axis), F.concat(F.lit(f"{name.strip('-')}="), brief).alias(short))
        parts.append(F.col(axis))
        labels.append(F.when(several, F.col(short)))
    grid = axes_grid(axes) if axes else spark.range(1).withColumnRenamed("id", "trial_id")
    label = F.concat_ws("_", *labels) if labels else F.lit("")
    command = F.concat_ws(" ", *parts)
    out = grid.select("trial_id", label.alias("label"), command.alias("command"))
    if target_dir is not None:
        out = out.withColumn("command", F.concat("command", F.lit(f" > {target_dir}/"), "label", F.lit(".txt")))
    return out


@dataclass(frozen=True)
class _Block:
    """A pure product inside a nested grid: columns with their values and stride in the trial number.

    Sizes are columns, as the length of a table is known only when the query runs.
    """

    offset: Column
    columns: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class TableValues:
    """Values of an option of a nested grid, from a table ``(value, at)`` of any length."""

    rows: DataFrame


def _leaf(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _values(value) -> list[str]:
    """All values an option takes: lists are walked, however deep; a dict gives one JSON text for each of its combinations."""
    if isinstance(value, (list, tuple)):
        return [v for item in value for v in _values(item)]
    if isinstance(value, dict):
        return [json.dumps(c) for c in _combinations(value)]
    return [_leaf(value)]


def _combinations(spec) -> list:
    """Trials of a small nested specification as dicts, the first key varying fastest; scalars stay."""
    if isinstance(spec, (list, tuple)):
        return [c for item in spec for c in _combinations(item)]
    if not isinstance(spec, dict):
        return [spec]
    out = [{}]
    for key, value in reversed(list(spec.items())):
        inner = _combinations(value)
        out = [{**(v if key.startswith("__sub") else {key: v}), **rest} for rest in out for v in inner]
    return out


def _blocks(spec, tables: list[DataFrame]) -> tuple[Column, list[_Block]]:
    """Number of trials and blocks; option tables are put on a list, and named by their place on it."""
    if isinstance(spec, (list, tuple)):
        total, out = F.lit(0).cast("long"), []
        for item in spec:
            size, blocks = _blocks(item, tables)
            out += [replace(b, offset=b.offset + total) for b in blocks]
            total = total + size
        return total, out
    total, out = F.lit(1).cast("long"), [_Block(F.lit(0).cast("long"))]
    for key, value in spec.items():
        if key.startswith("__sub"):
            size, inner = _blocks(value, tables)
        elif isinstance(value, TableValues):
            tables.append(value.rows)
            size = F.col(f"_n_t{len(tables) - 1}")
            inner = [_Block(F.lit(0).cast("long"), ((key, len(tables) - 1, F.lit(1).cast("long")),))]
        else:
            values = _values(value)
            size, inner = F.lit(len(values)).cast("long"), [_Block(F.lit(0).cast("long"), ((key, tuple(values), F.lit(1).cast("long")),))]
        out = [
            _Block(a.offset + b.offset * total, a.columns + tuple((n, v, s * total) for n, v, s in b.columns))
            for b in inner
            for a in out
        ]
        total = total * size
    return total, out


def nested_grid(spark: SparkSession, spec: dict | list) -> DataFrame:
    """Trials of a nested specification of dicts and lists; the first key varies fastest.

    ``__sub*`` keys splice the columns of a sub-grid in. Lists inside a list of values are walked. Options a trial does not
    set are NULL. Values are strings (JSON text for anything that is not a string). An option's values may be a
    ``TableValues``. Only the specification itself is walked here.
    """
    tables: list[DataFrame] = []
    _, blocks = _blocks(spec, tables)
    named = {f"t{i}": t.select(F.col("at").cast("long").alias(f"_at_t{i}"), F.col("value").cast("string").alias(f"t{i}")) for i, t in enumerate(tables)}
    lengths = None
    for name, table in named.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("axis"), "n")
        lengths = one if lengths is None else lengths.unionByName(one)
    sizes = lengths.agg(*[F.max(F.when(F.col("axis") == name, F.col("n"))).alias(f"_n_{name}") for name in named]) if named else spark.range(1).drop("id")
    parts = []
    for block in blocks:
        total = F.lit(1).cast("long")
        for _, values, _ in block.columns:
            total = total * (F.col(f"_n_t{values}") if isinstance(values, int) else F.lit(len(values)))
        pieces = sizes.withColumn("_total", total).where("_total > 0").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_total") - 1, GRID_BITS))))
        last = F.least(F.col("_total"), F.shiftleft(F.col("_piece") + 1, GRID_BITS)) - 1
        grid = pieces.repartition("_piece").withColumn("_id", F.explode(F.sequence(F.shiftleft("_piece", GRID_BITS), last)))
        rest, number, chosen = F.col("_id"), block.offset, []
        for name, values, stride in block.columns:
            size = F.col(f"_n_t{values}") if isinstance(values, int) else F.lit(len(values)).cast("long")
            digit = rest % size
            rest = F.call_function("div", rest, size)
            number = number + digit * stride
            if isinstance(values, int):
                grid = grid.withColumn(f"_at_t{values}", digit)
            chosen.append((F.col(f"t{values}") if isinstance(values, int) else pick(values, digit)).alias(name))
        grid = grid.withColumn("_number", number)
        for _, values, _ in block.columns:
            grid = grid.join(named[f"t{values}"], f"_at_t{values}") if isinstance(values, int) else grid
        parts.append(grid.select(F.col("_number").alias("trial_id"), *chosen))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def assign_groups(trials: DataFrame, id_col: str, n: int, seed: int | None = None, bits: int = 16) -> DataFrame:
    """Number the trials and cut them into groups of ``n`` (``n <= 0``: one group).

    With a seed, the order is a pseudo-random shuffle: by the MD5 of seed and id. The numbering counts per
    block of the order and adds the sizes of earlier blocks, so no task sees all trials.
    """
    if seed is None:
        d = dense_positions(trials, [], [id_col], F.shiftright(F.col(id_col).cast("long"), bits), "seq")
    else:
        d = trials.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
        d = dense_positions(d, [], ["_h", id_col], F.conv(F.substring("_h", 1, 4), 16, 10).cast("long"), "seq").drop("_h")
    group = F.lit(0).cast("long") if n <= 0 else F.expr(f"seq div {n}")
    return d.withColumn("group_id", group)
