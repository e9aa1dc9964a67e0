"""Relabelling rules over label maps, in the order they are given.

``__name__`` in the map is the metric's name.  Expressions are not anchored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("replace", "keep", "drop", "labeldrop", "labelkeep", "labelmap")


def _source(rule: Mapping, labels: Column) -> Column:
    return F.concat_ws(rule.get("separator", ";"), *[F.coalesce(labels[k], F.lit("")) for k in rule.get("source_labels", [])])


def _expand(text: Column, pattern: str, replacement: str) -> Column:
    """The replacement with $0 to $n filled from the first match; numbers without a group stay as written."""
    groups = re.compile(pattern).groups
    parts = []
    for part in re.split(r"(\$\d+)", replacement):
        if part.startswith("$") and part[1:].isdigit() and int(part[1:]) <= groups:
            parts.append(F.regexp_extract(text, pattern, int(part[1:])))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts) if parts else F.lit("")


def _put(labels: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(labels, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _keys_where(labels: Column, pattern: str, matched: bool) -> Column:
    return F.map_filter(labels, lambda k, _: k.rlike(pattern) if matched else ~k.rlike(pattern))


def _renamed(labels: Column, pattern: str, replacement: str) -> Column:
    return F.transform_keys(labels, lambda k, _: _expand(k, pattern, replacement))


def apply(df: DataFrame, rules: Sequence[Mapping], labels: str = "labels") -> DataFrame:
    """Rows with relabelled maps; rows that a rule drops are gone.  Fixed values of the format: names of actions and what a rule leaves out."""
    for rule in rules:
        action, pattern = rule.get("action", "replace"), rule.get("regex", "(.*)")
        c = F.col(labels)
        if action == "replace":
            text = _source(rule, c)
            df = df.withColumn(labels, F.when(text.rlike(pattern), _put(c, rule.get("target_label", "__name__"), _expand(text, pattern, rule.get("replacement", "$1")))).otherwise(c))
        elif action in ("keep", "drop"):
            hit = _source(rule, c).rlike(pattern)
            df = df.where(hit if action == "keep" else ~hit)
        elif action in ("labeldrop", "labelkeep"):
            df = df.withColumn(labels, _keys_where(c, pattern, action == "labelkeep"))
        elif action == "labelmap":
            # A matched label is renamed; on a clash the renamed one wins.
            moved = _renamed(_keys_where(c, pattern, True), pattern, rule.get("replacement", "$1"))
            df = df.withColumn(labels, F.map_concat(_keys_where(c, pattern, False), moved))
        else:
            raise ValueError(f"unknown relabel action {action!r}")
    return df


def drop_meta(labels: Column) -> Column:
    """Without labels that begin with two underscores, the name excepted."""
    return F.map_filter(labels, lambda k, _: ~k.startswith("__") | (k == "__name__"))


def honor_labels(scraped: Column, target: Column, honor: bool) -> Column:
    """Labels of the scrape and of its target; where both have one, the scraped value wins or is kept under exported_<name>."""
    if honor:
        return F.map_concat(target, scraped)
    renamed = F.transform_keys(scraped, lambda k, _: F.when(F.array_contains(F.map_keys(target), k), F.concat(F.lit("exported_"), k)).otherwise(k))
    return F.map_concat(renamed, target)
