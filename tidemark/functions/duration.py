"""Bucket widths, durations and points in time.  ``now`` is always an argument."""

from __future__ import annotations

import re

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
NAMED = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
PLURAL = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def bucket_seconds(spec: int | str | tuple[int, str]) -> int:
    """Width of a bucket: seconds, a name, (n, unit in words), or a duration like 5m."""
    if isinstance(spec, bool):
        raise ValueError(f"no bucket: {spec!r}")
    if isinstance(spec, int):
        n = spec
    elif isinstance(spec, tuple):
        n = spec[0] * PLURAL[spec[1]]
    else:
        n = NAMED.get(spec) or duration_seconds(spec)
    if n <= 0:
        raise ValueError(f"a bucket needs a positive width: {spec!r}")
    return n


def duration_seconds(text: str) -> int:
    """``90``, ``15s``, ``5m``, ``2h``, ``1d`` or ``1w`` in seconds."""
    m = re.fullmatch(r"(\d+)([smhdw]?)", text.strip())
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * UNITS[m[2] or "s"]


def moment(text: str | int | float | None, now: int, default: int) -> int:
    """``now``, ``-1h`` (before now), or unix seconds (fractions are cut)."""
    if text is None or text == "":
        return default
    if isinstance(text, (int, float)):
        return int(text)
    if text == "now":
        return now
    if re.fullmatch(r"-\d+[smhdw]", text):
        return now - duration_seconds(text[1:])
    try:
        return int(float(text))
    except ValueError:
        return default


def chart_step(start: int, end: int) -> int:
    """About two hundred buckets over a range."""
    return max((end - start) // 200, 1)
