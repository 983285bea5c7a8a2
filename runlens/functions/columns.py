"""Scalar expressions. Each is one native Column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed3(x: Column) -> Column:
    """Three decimals of a double of at least 1, rounded on its exact binary value (half to even).

    ``format_string`` rounds the shortest decimal half up, which differs on ties. Here the fraction is scaled
    to an integer of 2**-53 steps, which is exact.
    """
    steps = ((x - F.floor(x)) * F.lit(float(2**53))).cast("long") * 1000
    rest = F.pmod(steps, F.lit(2**53))
    q = F.shiftright(steps, 53)
    up = (rest > 2**52) | ((rest == 2**52) & (F.pmod(q, F.lit(2)) == 1))
    q = q + up.cast("long")
    whole = F.floor(x) + (q == 1000).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(F.pmod(q, F.lit(1000)).cast("string"), 3, "0"))


def human_bytes(n: Column) -> Column:
    """``1.500 GB`` / MB / KB above 1024, else ``n bytes``; a negative size is an error."""
    n = n.cast("long")
    scaled = lambda power, unit: F.concat(fixed3(n / F.lit(float(2**power))), F.lit(f" {unit}"))
    return (
        F.when(n < 0, F.raise_error(F.lit("negative byte count")).cast("string"))
        .when(n >= 2**30, scaled(30, "GB"))
        .when(n >= 2**20, scaled(20, "MB"))
        .when(n >= 2**10, scaled(10, "KB"))
        .when(n.isNotNull(), F.format_string("%d bytes", n))
    )


def human_duration(seconds: Column) -> Column:
    """``30H 05M 09S``; hours are not wrapped at a day."""
    s = seconds.cast("long")
    rest = F.pmod(s, F.lit(3600))
    hours = ((s - rest) / 3600).cast("long")
    sec = F.pmod(rest, F.lit(60))
    return F.when(s.isNotNull(), F.format_string("%dH %02dM %02dS", hours, ((rest - sec) / 60).cast("long"), sec))


def human_count(n: Column) -> Column:
    """``1.5K``, ``2M``: three decimals with trailing zeros removed; plain numbers below 1000."""
    x = n.cast("double")
    trim = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    plain = n.cast("string")
    small = F.when(plain.contains("."), trim(plain)).otherwise(plain)
    return (
        F.when(x < 1e3, small)
        .when(x < 1e6, F.concat(trim(fixed3(x / 1e3)), F.lit("K")))
        .when(x.isNotNull(), F.concat(trim(fixed3(x / 1e6)), F.lit("M")))
    )


def parse_pairs(items: Column) -> Column:
    """``k=v`` strings to a map. Text after a second ``=`` stays in the value; the last of equal keys wins."""
    keys = F.transform(items, lambda s: F.substring_index(s, "=", 1))
    entries = F.transform(
        items,
        lambda s, i: F.struct(
            F.substring_index(s, "=", 1).alias("key"),
            F.when(s.contains("="), F.substring(s, F.instr(s, "=") + 1, F.length(s))).alias("value"),
            i.alias("i"),
        ),
    )
    last = F.filter(entries, lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def parse_kv(text: Column) -> Column:
    """``k=v,k=v`` to a map."""
    return parse_pairs(F.split(text, ","))


def render_args(params: Column, skip: Sequence[str] = ()) -> Column:
    """Parameters as `` --k v``: true is a bare flag, false nothing; values with ``: ; |`` are quoted.

    A key ``--`` renders its value as a flag. ``skip`` names parameters passed another way.
    """

    def one(e: Column) -> Column:
        k, v = e["key"], e["value"]
        quoted = F.when(v.rlike("[:;|]"), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
        return (
            F.when(k == "--", F.concat(F.lit(" --"), v))
            .when(v == "false", F.lit(""))
            .when(v == "true", F.concat(F.lit(" --"), k))
            .otherwise(F.concat(F.lit(" --"), k, F.lit(" "), quoted))
        )

    kept = F.filter(F.map_entries(params), lambda e: ~e["key"].isin(*skip)) if skip else F.map_entries(params)
    return F.array_join(F.transform(F.array_sort(kept), one), "")


def render_env(params: Column, names: Sequence[str]) -> Column:
    """``k=v k=v`` for the named parameters."""
    kept = F.filter(F.map_entries(params), lambda e: e["key"].isin(*names))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


# How quotes and spaces are written inside a job comment.
QUOTE, SPACE = "@@@", "___"


def encode_comment(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit(QUOTE)), F.lit(" "), F.lit(SPACE))


def decode_comment(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(QUOTE), F.lit('"')), F.lit(SPACE), F.lit(" "))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last ``/``; empty without one."""
    return F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000


def run_signature(ts: Column) -> Column:
    """``2024-01-31_10-20-30_123456``."""
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss_SSSSSS")


def run_signature_short(ts: Column) -> Column:
    """``013124_102030_123456``."""
    return F.date_format(ts, "MMddyy_HHmmss_SSSSSS")


def array_slice(values: Column, begin: int, end: int, dim: int = 0) -> Column:
    """Python-style ``[begin:end]`` with clipping, on the chosen dimension (0, 1 or 2) of a nested array."""
    if dim > 0:
        return F.transform(values, lambda v: array_slice(v, begin, end, dim - 1))
    size = F.size(values)
    at = lambda i: F.least(F.greatest(size + i, F.lit(0)) if i < 0 else F.lit(i), size)
    return F.slice(values, at(begin) + 1, F.greatest(at(end) - at(begin), F.lit(0)))


def array_item(values: Column, i: int, dim: int = 0) -> Column:
    """Element i along a dimension; out of range gives NULL. Negative i counts from the end."""
    if dim > 0:
        return F.transform(values, lambda v: array_item(v, i, dim - 1))
    return F.try_element_at(values, F.lit(i + 1 if i >= 0 else i))


def array_flatten(values: Column) -> Column:
    """Merge the two outer dimensions."""
    return F.flatten(values)


def over_map(values: Column, fn) -> Column:
    """Apply an array function to every value of a map."""
    return F.transform_values(values, lambda _, v: fn(v))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.when(x == index, 1).otherwise(0))


def json_field(text: Column, field: str, kind: str = "string") -> Column:
    """One field of a JSON object; NULL if the text is not valid JSON or lacks it."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{field}", kind)
