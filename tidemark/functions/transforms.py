"""Value transforms, applied to bucket values before series are merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]


def multiply(n: float) -> Transform:
    return lambda v: v * F.lit(float(n))


def divide(n: float) -> Transform:
    if not n:
        raise ValueError("division by zero")
    return lambda v: v / F.lit(float(n))


def offset(n: float) -> Transform:
    return lambda v: v + F.lit(float(n))


def scale(m: float, b: float) -> Transform:
    return lambda v: v * F.lit(float(m)) + F.lit(float(b))


def log10() -> Transform:
    """Values that have no logarithm give 0."""
    return lambda v: F.when(v > 0, F.log10(v)).otherwise(F.lit(0.0))


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def parse(text: str | None) -> Transform | None:
    """``multiply:8``, ``divide:10``, ``offset:-3``, ``scale:1.8:32`` or ``log10``; None for anything else."""
    name, *args = (text or "").split(":")
    kinds = {"multiply": (multiply, 1), "divide": (divide, 1), "offset": (offset, 1), "scale": (scale, 2), "log10": (log10, 0)}
    if name not in kinds or len(args) != kinds[name][1]:
        return None
    return kinds[name][0](*map(_number, args))


def parse_threshold(text: str | None) -> tuple[str, float] | None:
    """``filter_gt:90`` or ``filter_lt:10``."""
    name, _, value = (text or "").partition(":")
    return {"filter_gt": (">", _number(value)), "filter_lt": ("<", _number(value))}.get(name) if value else None
