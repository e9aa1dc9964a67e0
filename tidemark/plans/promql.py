"""A PromQL subset: a tokenizer, a recursive-descent parser, and a planner onto the DataFrame operators.

    query    = level [("<" | ">") number]
    level    = name "(" level ")" ["by" "(" [names] ")"] | windowed
    windowed = function "(" selector "[" duration "]" ")" | selector
    selector = [name] ["{" [matcher {"," matcher}] "}"]

The range is read but the bucket is the step; an outer aggregate counts only together
with ``by``; a threshold keeps whole series.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.duration import duration_seconds
from tidemark.functions.matchers import Matcher
from tidemark.operators import query as q
from tidemark.operators.aggregates import SERIES

#: Functions over a range and the bucket aggregate of each, and outer aggregates.
OVER_RANGE = {"avg_over_time": "avg", "min_over_time": "min", "max_over_time": "max", "sum_over_time": "sum", "count_over_time": "count", "rate": "rate", "irate": "rate"}
ACROSS = ("avg", "min", "max", "sum", "count")
LOOKBACK = 300


class PromQLError(ValueError):
    """The query cannot be run."""


class _Unreadable(PromQLError):
    """The grammar has no place for the text."""


@dataclass(frozen=True)
class Selector:
    metric: str | Matcher
    labels: dict[str, Matcher]


@dataclass(frozen=True)
class Windowed:
    """A selector's buckets: ``function`` over a range, or avg."""

    of: Selector
    function: str | None = None
    seconds: int | None = None


@dataclass(frozen=True)
class Grouped:
    of: Windowed
    across: str | None
    by: tuple[str, ...]


@dataclass(frozen=True)
class Passing:
    of: Windowed | Grouped
    op: str
    limit: float


Query = Windowed | Grouped | Passing

_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_]))|(?P<word>[A-Za-z0-9_:.][A-Za-z0-9_:.-]*)|(?P<sign>=~|!~|!=|[=<>{}()\[\],]))""")


class _Reader:
    """Tokens of a query, read from left to right."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise _Unreadable(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next_is(self, *signs: str, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.tokens) and self.tokens[self.at + ahead][1] in signs and self.tokens[self.at + ahead][0] != "text"

    def take(self, *kinds: str) -> str:
        """The next token, which must be of one of these kinds or be one of these signs."""
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")
        if kind not in kinds and (kind == "text" or text not in kinds):
            raise _Unreadable(f"expected {' or '.join(kinds)}, found {text}")
        self.at += 1
        return text

    def several(self, close: str, read) -> list:
        """What ``read`` reads, between commas, up to the closing sign."""
        out = []
        while not self.next_is(close):
            out.append(read())
            if not self.next_is(close):
                self.take(",")
        self.take(close)
        return out

    def query(self) -> Query:
        out: Query = self.level()
        if self.next_is("<", ">"):
            out = Passing(out, self.take("<", ">"), float(self.take("number")))
        if self.at < len(self.tokens):
            raise _Unreadable(f"unexpected {self.tokens[self.at][1]}")
        return out

    def level(self) -> Windowed | Grouped:
        if self.next_is(*ACROSS) and self.next_is("(", ahead=1):
            across = self.take("word")
            self.take("(")
            out = self.level()
            self.take(")")
            return self.by(out, across)
        return self.by(self.windowed(), None)

    def by(self, of: Windowed | Grouped, across: str | None) -> Windowed | Grouped:
        if not self.next_is("by"):
            return of
        self.take("word")
        self.take("(")
        names = tuple(self.several(")", lambda: self.take("word")))
        if isinstance(of, Grouped):
            raise _Unreadable("groups of groups are not supported")
        return Grouped(of, across, names) if names else of

    def windowed(self) -> Windowed:
        if not (self.next_is(*OVER_RANGE) and self.next_is("(", ahead=1)):
            return Windowed(self.selector())
        function = self.take("word")
        self.take("(")
        of = self.selector()
        self.take("[")
        seconds = duration_seconds(self.take("word"))
        self.take("]")
        self.take(")")
        return Windowed(of, function, seconds)

    def selector(self) -> Selector:
        name = self.take("word") if not self.next_is("{") else None
        matchers: list[tuple[str, Matcher]] = []
        if self.next_is("{"):
            self.take("{")
            matchers = self.several("}", self.matcher)
        labels = dict(matchers)
        own = labels.pop("__name__", None)
        if own is not None and own.op not in ("=", "=~"):
            raise PromQLError(f"__name__ takes = or =~, not {own.op}")
        if own is not None and own.op == "=~":
            return Selector(own, labels)
        name = name or (own.value if own else None)
        if not name:
            raise PromQLError("a selector needs a metric name")
        return Selector(name, labels)

    def matcher(self) -> tuple[str, Matcher]:
        name, op, text = self.take("word"), self.take("=", "!=", "=~", "!~"), self.take("text")
        return name, Matcher(op, re.sub(r"\\([\"'])", r"\1", text[1:-1]))


def parse(text: str) -> Query:
    """The tree of a query.  What the grammar cannot read counts as the name of a metric, which then matches nothing."""
    if not text.strip():
        raise PromQLError("empty query")
    try:
        return _Reader(text).query()
    except _Unreadable:
        return Windowed(Selector(text.strip(), {}))


def selector_of(query: Query) -> Selector:
    while not isinstance(query, Selector):
        query = query.of
    return query


def execute(points: DataFrame, query: str | Query, start: int, end: int, step: int) -> tuple[DataFrame, list[str]]:
    """(result, keys): buckets of ``step`` seconds; keys are the columns that name a series or group."""
    tree = parse(query) if isinstance(query, str) else query
    if isinstance(tree, Passing):
        out, keys = execute(points, tree.of, start, end, step)
        # With a pattern for the metric, groups are not filtered.
        if isinstance(tree.of, Grouped) and isinstance(selector_of(tree).metric, Matcher):
            return out, keys
        return q.threshold(out, tree.op, tree.limit, keys=keys), keys
    selector = selector_of(tree)
    inner = tree.of if isinstance(tree, Grouped) else tree
    args = (points, selector.metric, selector.labels)
    name = OVER_RANGE.get(inner.function or "", "avg")
    if isinstance(tree, Grouped):
        return q.aggregate_grouped(*args, list(tree.by), step, name, tree.across, start, end), list(tree.by)
    return q.aggregate_multi(*args, step, name, start, end), list(SERIES)


def instant(points: DataFrame, query: str | Query, at: int) -> tuple[DataFrame, list[str]]:
    """Last bucket of the LOOKBACK window; it may be a partial one, since buckets follow the epoch."""
    out, keys = execute(points, query, at - LOOKBACK, at, LOOKBACK)
    more = [F.any_value("labels").alias("labels")] if "labels" in out.columns else []
    return out.groupBy(*keys).agg(*more, F.max("bucket").alias("bucket"), F.max_by("value", "bucket").alias("value")), keys
