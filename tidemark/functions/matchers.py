"""Label matchers as column predicates.

Equality and regular expressions need the label to be there; the negated ones accept
series without it.  Expressions are anchored at both ends.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import series_key


@dataclass(frozen=True)
class Matcher:
    op: str  # = != =~ !~
    value: str


def eq(value: str) -> Matcher:
    return Matcher("=", value)


def regex(pattern: str) -> Matcher:
    return Matcher("=~", pattern)


def not_eq(value: str) -> Matcher:
    return Matcher("!=", value)


def not_regex(pattern: str) -> Matcher:
    return Matcher("!~", pattern)


Filter = Mapping[str, "Matcher | str"]


def anchored(pattern: str) -> str:
    return f"^(?:{pattern})$"


def matches(c: Column, m: Matcher | str) -> Column:
    m = m if isinstance(m, Matcher) else eq(m)
    if m.op == "=":
        return c == m.value
    if m.op == "=~":
        return c.rlike(anchored(m.value))
    if m.op == "!=":
        return F.coalesce(c != m.value, F.lit(True))
    if m.op == "!~":
        return F.coalesce(~c.rlike(anchored(m.value)), F.lit(True))
    raise ValueError(f"unknown matcher {m.op!r}")


def label_filter(labels: Filter | None) -> Column:
    """Series whose labels pass all matchers; other labels do not matter."""
    return reduce(lambda a, b: a & b, [matches(F.col("labels")[k], m) for k, m in (labels or {}).items()], F.lit(True))


def exact(labels: Mapping[str, str]) -> Column:
    """The one series that has these labels and no others."""
    pairs = [F.lit(x) for k in sorted(labels) for x in (k, str(labels[k]))]
    return F.col("series_key") == series_key(F.create_map(*pairs).cast("map<string,string>") if pairs else F.create_map().cast("map<string,string>"))


def metric_filter(metric: str | Matcher | list[str]) -> Column:
    if isinstance(metric, list):
        return F.col("metric").isin(list(dict.fromkeys(metric)))
    return matches(F.col("metric"), metric)
