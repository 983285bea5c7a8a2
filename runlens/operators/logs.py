"""Logs to records: sections, tagged JSON, mode logs, rule-based extraction.

Logs are ``log_lines(folder, line_no, line)`` with ``line_no`` dense from 0 per log.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.blocks import (
    BLOCK,
    DEFAULT_BITS,
    block_of,
    dense_positions,
    last_before,
    running_count,
    running_sum,
    with_blocks,
)
from runlens.operators.keys import join_keys
from runlens.operators.reduce import union_runs
from runlens.plans.spec import Capture, Rule
from runlens.session import cut

# Texts a log uses to mark a (re)start, and the scheduler's preemption warnings.
JOB_START = "===*** Job start ***==="
PREEMPT_TAG, PREEMPT_SKIP = "[submitit][WARNING]", "Bypassing"
PREEMPT_SIGNALS = ("SIGTERM", "SIGUSR1", "SIGCONT")
# Fixed value: prefix of the line that announces a run's tracking page.
TRACKING_PREFIX = "wandb: 🚀 View run at "
# Lines that redirect a log to its sweep folder.
SWEEP_DIR = r"Sweep output dir\s*:\s*(.*)$"
SWEEP_DIR_REQUIRED = r"sweep output dir : (.*)$"
# Line formats of tagged JSON logs and mode logs.
TAGGED = r"(?s)^\s*([0-9]+:|)\s*(args|stats):(.*)$"
MODE_STEP = r"^Total step: ([\d\.]+)M"
MODE_SCORE = r"^Accumulated: [\d\.]+\[\d+\], Last episode\[16\] Avg: ([\d\.]+)"


def is_restart(line: Column) -> Column:
    """A job-start marker, or a preemption warning that is not bypassed."""
    signal = fold(lambda a, b: a | b, [line.contains(s) for s in PREEMPT_SIGNALS])
    return line.contains(JOB_START) | (line.contains(PREEMPT_TAG) & ~line.contains(PREEMPT_SKIP) & signal)


def longest_ranges(lines: DataFrame, marker: Column | None = None, keys: Sequence[str] = ("folder",), bits: int = DEFAULT_BITS) -> DataFrame:
    """First and last line number of each log's longest section (``_from``, ``_to``), the last of equally long ones.

    A marker line opens a section; lines before the first marker form one. One scan, of line numbers and marks: a window
    per (log, block) finds the parts of sections in it, and the parts, few rows, are put together by a running count.
    """
    marker = F.coalesce(is_restart(F.col("line")) if marker is None else marker, F.lit(False))
    narrow = lines.select(*keys, "line_no", marker.cast("int").alias("_m"), block_of("line_no", bits).alias(BLOCK))
    within = Window.partitionBy(*keys, BLOCK).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        narrow.withColumn("_part", F.sum("_m").over(within)).groupBy(*keys, BLOCK, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_from"), F.max("line_no").alias("_to"))
    )
    # the first part of a block goes on with the last section before it; parts are checkpointed, since they are read twice
    opens = running_sum(cut(parts.drop(BLOCK)), keys, ["_from"], block_of("_from", bits), F.col("_part") > 0, "_section")
    sections = opens.groupBy(*keys, "_section").agg(F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    pick = sections.groupBy(*keys).agg(F.max(F.struct("_n", "_section", "_from", "_to")).alias("_s"))
    return pick.select(*keys, "_s._from", "_s._to")


def within_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("folder",), bits: int = DEFAULT_BITS) -> DataFrame:
    """Rows whose line number lies in their log's range; joined per block of lines, so a huge log spreads out."""
    per_block = ranges.withColumn(BLOCK, F.explode(F.sequence(block_of("_from", bits), block_of("_to", bits))))
    inside = F.col("line_no").between(F.col("_from"), F.col("_to"))
    return rows.withColumn(BLOCK, block_of("line_no", bits)).join(per_block, [*keys, BLOCK]).where(inside).drop(BLOCK, "_from", "_to")


def longest_section(lines: DataFrame, marker: Column | None = None, keys: Sequence[str] = ("folder",), bits: int = DEFAULT_BITS) -> DataFrame:
    """Lines of each log's longest section: one scan finds the ranges, one reads the lines."""
    return within_ranges(lines, longest_ranges(lines, marker, keys, bits), keys, bits)


def _captured(rule: Rule, capture: Capture) -> Column:
    return capture.expr(F.col("line")) if capture.expr else F.regexp_extract("line", rule.pattern, capture.group)


def capture_events(lines: DataFrame, matchers: Sequence[Sequence[Rule]], keys: Sequence[str] = ("folder",)) -> DataFrame:
    """Every capture of every rule, in one scan: ``(keys, line_no, act, matcher, key, value, text, failed)``.

    ``value`` is the number of a numeric capture (``failed`` if it is none), ``text`` the raw capture. ``act``
    keeps the order of rules and captures on one line.
    """
    items = []
    for m, rules in enumerate(matchers):
        for rule in rules:
            hit = F.col("line").rlike(rule.pattern)
            for cap in rule.captures:
                raw = _captured(rule, cap)
                number = raw.try_cast("double") if cap.type != "string" else F.lit(None).cast("double")
                failed = number.isNull() if cap.type != "string" else F.lit(False)
                event = F.struct(
                    F.lit(len(items)).alias("act"), F.lit(m).alias("matcher"), F.lit(cap.key).alias("key"),
                    number.alias("value"), raw.cast("string").alias("text"), failed.alias("failed"),
                )
                items.append(F.when(hit, event))
    rows = lines.select(*keys, "line_no", F.explode(F.array_compact(F.array(*items))).alias("_e"))
    return rows.select(*keys, "line_no", "_e.*")


def _number_events(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    out = dense_positions(rows, [*keys, "key"], ["line_no", "act"], block_of("line_no", bits))
    return out.select(*keys, "key", "pos", "value", "text", "failed")


def extract_events(lines: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("folder",), bits: int = DEFAULT_BITS) -> DataFrame:
    """Points from every line that matches a rule: ``(keys, key, pos, value, text, failed)``.

    One line may feed several rules and one rule several keys, in rule order. The log is scanned once: what it yields
    is checkpointed and numbered from there.
    """
    return _number_events(cut(capture_events(lines, [rules], keys)), keys, bits)


def rule_marks(lines: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("folder",)) -> DataFrame:
    """What each armed rule saw, in one scan: ``(keys, rule, line_no, line, mark)``, mark ``arm`` or ``match``.

    A line that matches both counts as a match first and arms the rule for the next one.
    """
    seen = []
    for i, rule in enumerate(rules):
        if rule.arm is not None:
            mark = lambda pattern, name, step, i=i: F.when(F.col("line").rlike(pattern), F.struct(F.lit(i).alias("rule"), F.lit(step).alias("step"), F.lit(name).alias("mark")))
            seen += [mark(rule.pattern, "match", 0), mark(rule.arm, "arm", 1)]
    if not seen:
        seen = [F.lit(None).cast("struct<rule:int,step:int,mark:string>")]
    rows = lines.select(*keys, "line_no", "line", F.explode(F.array_compact(F.array(*seen))).alias("_m"))
    return rows.select(*keys, "_m.rule", "line_no", "_m.step", "line", "_m.mark")


def armed_events(lines: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("folder",), before: DataFrame | None = None, bits: int = DEFAULT_BITS) -> tuple[DataFrame, DataFrame]:
    """(points, arming): points as ``extract_events`` gives them, of rules with and without ``arm``; and ``(keys, rule, mark)``.

    A rule is armed where the last thing it saw is an arming line, so a log of any size is cut into blocks. ``before(keys,
    rule, mark)`` is the arming that earlier lines left; the arming returned is that after these lines.
    """
    keys = list(keys)
    free = [r for r in rules if r.arm is None]
    marks = cut(rule_marks(lines, rules, keys))
    judged = last_before(marks, [*keys, "rule"], ["line_no", "step"], block_of("line_no", bits), F.col("mark"), "_before", before)
    hits = judged.where("mark = 'match' and _before = 'arm'")
    parts = [capture_events(lines, [free], keys)] if free else []
    for i, rule in enumerate(rules):
        if rule.arm is not None:
            parts.append(capture_events(hits.where(F.col("rule") == i), [[rule]], keys))
    events = union_runs(parts)
    after = marks.select(*keys, "rule", "line_no", "step", "mark").withColumn("_at", F.struct("line_no", "step"))
    if before is not None:
        first = before.select(*keys, "rule", F.lit(-1).cast("long").alias("line_no"), F.lit(0).alias("step"), "mark").withColumn("_at", F.struct("line_no", "step"))
        after = after.unionByName(first)
    return _number_events(cut(events), keys, bits), after.groupBy(*keys, "rule").agg(F.max_by("mark", "_at").alias("mark"))


def extract_first(lines: DataFrame, rule: Rule, keys: Sequence[str] = ("folder",), explode_rows: bool = False) -> DataFrame:
    """Captures of the first matching line per log. With ``explode_rows``, list captures become rows."""
    captured = []
    for c in rule.captures:
        raw = _captured(rule, c)
        captured.append((raw.try_cast(c.type) if c.expr is None else raw).alias(c.key))
    first = (
        lines.where(F.col("line").rlike(rule.pattern))
        .select(*keys, "line_no", F.struct(*captured).alias("_c"))
        .groupBy(*keys)
        .agg(F.min_by("_c", "line_no").alias("_c"))
        .select(*keys, "_c.*")
    )
    if explode_rows:
        names = [c.key for c in rule.captures]
        first = first.select(*keys, F.inline(F.arrays_zip(*names)).alias(*names))
    return first


def merge_matchers(
    lines: DataFrame, matchers: Sequence[Sequence[Rule]], keys: Sequence[str] = ("folder",), ranges: DataFrame | None = None,
    bits: int = DEFAULT_BITS,
) -> DataFrame:
    """Points of several matchers: for each log and key, those of the last matcher that has the key.

    A matcher with a failed capture in a log contributes nothing for that log (see ``match_failures``). With
    ``ranges``, only lines inside their log's range count. The captures, a small part of the log, are
    checkpointed once; what follows reads them, not the log.
    """
    keys = list(keys)
    events = capture_events(lines, matchers, keys)
    events = cut(within_ranges(events, ranges, keys, bits) if ranges is not None else events)
    series = events.groupBy(*keys, "matcher", "key").agg(F.bool_or("failed").alias("failed"))
    failed = series.where("failed").select(*keys, "matcher").distinct()
    winner = series.join(failed, [*keys, "matcher"], "left_anti").groupBy(*keys, "key").agg(F.max("matcher").alias("matcher"))
    return _number_events(events.join(winner, [*keys, "key", "matcher"], "left_semi"), keys, bits)


def match_failures(part: DataFrame, keys: Sequence[str] = ("folder",)) -> DataFrame:
    return part.where("failed").groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n_failed"))


def error_tail(lines: DataFrame, n: int = 3, keys: Sequence[str] = ("folder",), needle: str = "Error") -> DataFrame:
    """Last n lines that contain ``needle``, in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("line_no"))
    last = lines.where(F.col("line").contains(needle)).withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return last.groupBy(*keys).agg(F.transform(ordered, lambda s: s["line"]).alias("errors"))


def tracking_url(lines: DataFrame, keys: Sequence[str] = ("folder",), prefix: str = TRACKING_PREFIX) -> DataFrame:
    """Text after the prefix on the first line that starts with it; NULL for logs without such a line."""
    starts = F.col("line").startswith(prefix)
    url = F.trim(F.substring("line", F.lit(len(prefix) + 1), F.length("line")))
    return lines.groupBy(*keys).agg(F.min_by(F.when(starts, url), F.when(starts, F.col("line_no"))).alias("url"))


def resolve_sweep_dir(
    lines: DataFrame,
    keys: Sequence[str] = ("folder",),
    pattern: str = SWEEP_DIR,
    required: bool = False,
    roots: Sequence[str] = (),
    known: DataFrame | None = None,
    suffix: str = "",
) -> DataFrame:
    """Folder named by the first redirect line of each log; without one, the log's own path, or an error if ``required``.

    ``SWEEP_DIR_REQUIRED`` is the stricter form of the line that logs given in place of a folder must hold. A relative name
    is looked up below each of ``roots`` in turn, among the folders of ``known(folder)``; one found nowhere is NULL. Only
    paths that end in ``suffix`` are redirected.
    """
    hit = F.col("line").rlike(pattern)
    target = F.regexp_extract("line", pattern, 1)
    first = lines.groupBy(*keys).agg(F.min_by(F.when(hit, target), F.when(hit, F.col("line_no"))).alias("_t"))
    own = F.col(keys[0]).cast("string")
    missing = F.raise_error(F.concat(F.lit("no sweep folder named in "), own)).cast("string") if required else own
    if suffix:
        first = first.withColumn("_t", F.when(own.endswith(suffix), F.col("_t")).otherwise(own))
    named = first.select(*keys, F.coalesce("_t", missing).alias("sweep_dir"))
    if known is None:
        return named
    places = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(r.rstrip("/") + "/"), "sweep_dir").alias("path")) for i, r in enumerate(roots)])
    tried = named.where(~F.col("sweep_dir").startswith("/")).select(*keys, F.inline(places)).join(known.select(F.col("folder").alias("path")).distinct(), "path")
    found = tried.groupBy(*keys).agg(F.min_by("path", "rank").alias("_found"))
    absolute = F.when(F.col("sweep_dir").startswith("/"), F.col("sweep_dir"))
    return join_keys(named, found, keys, "left").select(*keys, F.coalesce(absolute, "_found").alias("sweep_dir"))


def align_dicts(records: DataFrame, keys: Sequence[str] = ("run_id",), values: str = "values") -> DataFrame:
    """Ordered maps as aligned series: every key of a run has a row at every position, NULL where it was absent."""
    keys = list(keys)
    names = records.select(*keys, F.explode(F.map_keys(values)).alias("key")).distinct()
    per_run = names.groupBy(*keys).agg(F.sort_array(F.collect_list("key")).alias("_names"))
    spread = records.join(per_run, keys).withColumn("key", F.explode("_names"))
    return spread.select(*keys, "pos", "key", F.try_element_at(F.col(values), F.col("key")).alias("value"))


def pack_series(points: DataFrame, keys: Sequence[str], value: str = "value", chunk: int = 10_000) -> DataFrame:
    """Arrays of up to ``chunk`` consecutive values per series; longer series take several rows."""
    packed = points.groupBy(*keys, F.expr(f"pos div {chunk}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", value))).alias("_v")
    )
    return packed.select(*keys, "chunk", F.transform("_v", lambda s: s[value]).alias("values"))


def series_subkey(series: Column, key: str) -> Column:
    """List of maps to list of numbers; a map without the key is an error."""
    missing = F.raise_error(F.lit(f"missing subkey {key}")).cast("double")
    return F.transform(
        series, lambda d: F.when(F.map_contains_key(d, F.lit(key)), F.try_element_at(d, F.lit(key))).otherwise(missing)
    )


def parse_tagged_json(lines: DataFrame, prefix: str = "file", bits: int = DEFAULT_BITS) -> DataFrame:
    """``[task:] args|stats: {json}`` lines to records ``(file, key, kind, seq, payload, failed)``.

    A counter rises on every ``args`` line of the file; the key is ``prefix-task-counter`` and keeps the
    task's colon. ``payload`` is JSON text; text that doesn't parse makes a NULL payload and ``failed``.
    """
    part = lambda i: F.regexp_extract("line", TAGGED, i)
    tagged = lines.where(F.col("line").rlike(TAGGED)).select(
        "file", F.col(prefix).cast("string").alias("_prefix"), "line_no", part(1).alias("_task"), part(2).alias("kind"), part(3).alias("payload")
    )
    counted = running_count(tagged, ["file"], "line_no", F.col("kind") == "args", "_args", bits)
    key = F.concat("_prefix", F.lit("-"), "_task", F.lit("-"), (F.col("_args") - 1).cast("string"))
    failed = F.try_parse_json("payload").isNull()
    payload = F.when(~failed, F.col("payload"))
    return counted.select("file", key.alias("key"), "kind", F.col("line_no").alias("seq"), payload.alias("payload"), failed.alias("failed"))


def group_records(records: DataFrame, file_order: str = "file") -> DataFrame:
    """Records per key from the last file that has the key, with their order within kind.

    The ``args`` and ``stats`` lists of a key are its rows by ``kind`` in ``seq`` order.
    """
    last = records.groupBy("key").agg(F.max(file_order).alias(file_order))
    return records.join(last, ["key", file_order], "left_semi")


def parse_namespace(line: Column) -> Column:
    """``Namespace(a=1, b='x')`` to a map of texts, quotes removed."""
    pairs = F.regexp_extract_all(line, F.lit(r"(\w+)=('[^']*'|\"[^\"]*\"|[^,()]+)"), F.lit(0))
    key = lambda s: F.substring_index(s, "=", 1)
    value = lambda s: F.regexp_replace(F.substring(s, F.instr(s, "=") + 1, F.length(s)), "^['\"]|['\"]$", "")
    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(key(s).alias("key"), value(s).alias("value"))))


def mode_args(lines: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Arguments from ``Namespace(...)`` lines."""
    return lines.where(F.col("line").startswith("Namespace")).select(*keys, F.col("line_no").alias("seq"), parse_namespace(F.col("line")).alias("args"))


def parse_mode_log(
    lines: DataFrame, keys: Sequence[str] = ("file",), bits: int = DEFAULT_BITS, hot_rows: int | None = None
) -> DataFrame:
    """``(step, test_avg)`` rows from a log of training and evaluation phases.

    ``Train:`` arms training; the next step line then sets the step and disarms it. ``Eval:`` arms evaluation;
    the next score line emits a row, disarms it and clears the step. While training is armed, score lines
    are not looked at.

    Only the last relevant event before a line matters for each flag, so windows decide them. Huge logs are cut
    into blocks. What holds at the start of a block is one of (training armed?) x (evaluation armed?): each
    block is summarised for all four cases and the summaries are chained per log.
    """
    keys = list(keys)
    line = F.col("line")
    kind = (
        F.when(line.startswith("Eval:"), "E").when(line.startswith("Train:"), "T")
        .when(line.rlike(MODE_STEP), "S").when(line.rlike(MODE_SCORE), "A")
    )
    number = F.coalesce(
        F.when(line.rlike(MODE_STEP), F.regexp_extract("line", MODE_STEP, 1)), F.regexp_extract("line", MODE_SCORE, 1)
    ).try_cast("double")
    rows = (
        lines.where(~line.startswith("Namespace"))
        .select(*keys, "line_no", kind.alias("kind"), number.alias("x"))
        .where("kind is not null")
    )
    rows = with_blocks(rows, keys, block_of("line_no", bits), hot_rows)
    before = Window.partitionBy(*keys, BLOCK).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("kind")
    last = lambda cond: F.last(F.when(cond, k), ignorenulls=True).over(before)

    # last of {Train, step} before the line: training is armed iff it is Train
    rows = rows.withColumn("_ts", last(k.isin("T", "S")))
    for t in (0, 1):
        armed = F.coalesce(F.col("_ts") == "T", F.lit(bool(t)))
        rows = rows.withColumn(f"_step{t}", (k == "S") & armed).withColumn(f"_seen{t}", (k == "A") & ~armed)
    for t in (0, 1):
        rows = rows.withColumn(f"_ea{t}", last((k == "E") | F.col(f"_seen{t}")))
    event = lambda t, e: F.col(f"_step{t}") | (F.col(f"_seen{t}") & F.coalesce(F.col(f"_ea{t}") == "E", F.lit(bool(e))))
    # a step sets the value, an emission clears it (NaN stands for cleared)
    mark = F.when(k == "S", F.col("x")).otherwise(F.lit(float("nan")))

    w = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    cases = [(t, e) for t in (0, 1) for e in (0, 1)]
    pick = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("line_no")))
    blocks = rows.where(F.col(BLOCK).isNotNull()).groupBy(*keys, BLOCK).agg(
        pick(k.isin("T", "S"), k).alias("_l"),
        *[pick((k == "E") | F.col(f"_seen{t}"), k).alias(f"_l{t}") for t in (0, 1)],
        *[pick(event(t, e), mark).alias(f"_v{t}{e}") for t, e in cases],
    )
    blocks = blocks.withColumn("_t", F.coalesce(F.last("_l", ignorenulls=True).over(w) == "T", F.lit(False)))
    blocks = blocks.withColumn("_lt", F.when(F.col("_t"), F.col("_l1")).otherwise(F.col("_l0")))
    blocks = blocks.withColumn("_e", F.coalesce(F.last("_lt", ignorenulls=True).over(w) == "E", F.lit(False)))
    chosen = F.lit(None).cast("double")
    for t, e in cases:
        chosen = F.when((F.col("_t") == bool(t)) & (F.col("_e") == bool(e)), F.col(f"_v{t}{e}")).otherwise(chosen)
    blocks = blocks.withColumn("_v", chosen).withColumn("_step", F.last("_v", ignorenulls=True).over(w))

    state = rows.join(blocks.select(*keys, BLOCK, "_t", "_e", "_step"), [*keys, BLOCK], "left")
    state = state.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_t", "_e")})
    choose = lambda name: F.when(F.col("_t"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    state = state.withColumn("_is_step", choose("_step")).withColumn(
        "_emit", choose("_seen") & F.coalesce(choose("_ea") == "E", F.col("_e"))
    )
    latest = F.last(F.when(F.col("_is_step") | F.col("_emit"), mark), ignorenulls=True).over(before)
    step = F.coalesce(latest, F.col("_step"))
    return (
        state.withColumn("_now", step).where("_emit")
        .select(*keys, F.col("line_no").alias("seq"), F.when(~F.isnan("_now"), F.col("_now")).alias("step"), F.col("x").alias("test_avg"))
    )
