"""What a sweep declares about itself: rules, result groups, metric options, group order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class MetricOptions:
    topk: int = 10
    topk_mean: int = 5
    descending: bool = False
    subkey: str | None = None


@dataclass(frozen=True)
class Capture:
    """One value taken from a matching line: a regex group cast to ``type``, or any Column over ``line``."""

    key: str
    group: int = 1
    type: str = "double"
    expr: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Rule:
    """A regular expression (searched, not anchored) and the values a match yields.

    With ``arm``, a match only counts if a line that matches ``arm`` came after the match before it.
    """

    pattern: str
    captures: Sequence[Capture]
    arm: str | None = None


@dataclass(frozen=True)
class ResultGroup:
    """``kind`` is ``df`` (first matching line), ``event`` (every matching line) or ``func``.

    With ``explode_rows``, list captures of a ``df`` group become rows.
    """

    kind: str
    rules: Sequence[Rule] = ()
    func: Callable[[DataFrame], DataFrame] | None = None
    explode_rows: bool = False


@dataclass(frozen=True)
class SweepSpec:
    result_groups: dict[str, ResultGroup] = field(default_factory=dict)
    default_result_group: Sequence[str] = ()
    default_metrics: Sequence[str] = ()
    common_options: dict[str, Any] = field(default_factory=dict)
    specific_options: dict[str, dict[str, Any]] = field(default_factory=dict)
    default_group_order: Sequence[str] = ()

    def choose(self, selected: Sequence[str] | None = None) -> tuple[str, list[ResultGroup]]:
        """Selected result groups of the strongest kind: ``df`` beats ``event``, which beats ``func``."""
        picked = [self.result_groups[name] for name in (selected or self.default_result_group)]
        for kind in ("df", "event"):
            groups = [g for g in picked if g.kind == kind]
            if groups:
                return kind, groups
        return "func", [g for g in picked if g.kind == "func"]

    def options_for(self, metric: str, arguments: MetricOptions = MetricOptions()) -> MetricOptions:
        """Options of one metric: specific beats common, common beats the caller's arguments."""
        merged = {f.name: getattr(arguments, f.name) for f in fields(arguments)}
        for layer in (self.common_options, self.specific_options.get(metric, {})):
            merged.update({k: v for k, v in layer.items() if k in merged})
        return MetricOptions(**merged)

    def order_groups(self, groups: Sequence[str]) -> list[str]:
        """Listed keys first, in the listed order; the rest after, in theirs."""
        first = [g for g in self.default_group_order if g in groups]
        return first + [g for g in groups if g not in self.default_group_order]
