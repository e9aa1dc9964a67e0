"""SVG charts of a small, collected result."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from html import escape

from pyspark.sql import DataFrame

COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f")
#: Whole minutes that divide an hour, then whole hours that divide a day.
_TIME_STEPS = [60 * m for m in range(1, 60) if 60 % m == 0] + [3600 * h for h in range(1, 25) if 24 % h == 0]


def collect(result: DataFrame) -> list[tuple[dict, list[tuple[int, float]]]]:
    """(labels, buckets) of every series of a result that is small enough to look at."""
    series: dict = {}
    for r in result.orderBy("metric", "series_key", "bucket").collect():
        series.setdefault((r["metric"], r["series_key"]), (dict(r["labels"] or {}), []))[1].append((r["bucket"], r["value"]))
    return list(series.values())


def nice_ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round values (1, 2 or 5 times a power of ten) that span the range."""
    if high <= low:
        high = low + 1
    rough = (high - low) / about
    power = 10 ** math.floor(math.log10(rough))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= rough)
    first = math.ceil(low / step)
    return [k * step for k in range(first, math.floor(high / step) + 1)]


def time_ticks(start: int, end: int, about: int = 6) -> list[int]:
    """Multiples of the least step that gives at most ``about`` intervals; above a day, of whole days."""
    least = max(1, math.ceil((end - start) / about))
    step = min((x for x in _TIME_STEPS if x >= least), default=-(-least // 86400) * 86400)
    return list(range(-(-start // step) * step, end + 1, step))


def legend_key(labels: Sequence[Mapping[str, str]]) -> str | None:
    """The label with the most different values."""
    names = sorted({k for x in labels for k in x})
    return max(names, key=lambda k: len({x.get(k) for x in labels}), default=None)


def svg(series: Sequence[tuple[Mapping[str, str], Sequence[tuple[int, float]]]], title: str = "", width: int = 800, height: int = 300, forecast: Sequence[tuple[int, float]] = (), anomalies: Sequence[tuple[int, float]] = (), annotations: Sequence[tuple[int, str]] = ()) -> str:
    """Lines of all series, a dashed forecast, dots for anomalies, upright lines for annotations."""
    every = [p for _, data in series for p in data] + list(forecast) + list(anomalies)
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    if not every:
        return f'{head}<text x="{width // 2}" y="{height // 2}" text-anchor="middle">No data</text></svg>'
    t0, t1 = min(t for t, _ in every), max(t for t, _ in every)
    v0, v1 = min(v for _, v in every), max(v for _, v in every)
    x = lambda t: 60 + (width - 80) * (t - t0) / max(t1 - t0, 1)
    y = lambda v: height - 30 - (height - 60) * (v - v0) / ((v1 - v0) or 1)
    line = lambda data: " ".join(f"{x(t):.1f},{y(v):.1f}" for t, v in data)
    out = [head, f'<text x="10" y="18">{escape(title)}</text>']
    for v in nice_ticks(v0, v1):
        out.append(f'<line x1="60" x2="{width - 20}" y1="{y(v):.1f}" y2="{y(v):.1f}" stroke="#ddd"/><text x="55" y="{y(v):.1f}" text-anchor="end" font-size="10">{v:g}</text>')
    for t in time_ticks(t0, t1):
        label = datetime.fromtimestamp(t, UTC).strftime("%H:%M" if t1 - t0 <= 86400 else "%m-%d %H:%M")
        out.append(f'<text x="{x(t):.1f}" y="{height - 12}" text-anchor="middle" font-size="10">{label}</text>')
    for t, text in annotations:
        if t0 <= t <= t1:
            out.append(f'<line x1="{x(t):.1f}" x2="{x(t):.1f}" y1="30" y2="{height - 30}" stroke="#999" stroke-dasharray="2"><title>{escape(text)}</title></line>')
    key = legend_key([labels for labels, _ in series])
    for i, (labels, data) in enumerate(series):
        out.append(f'<polyline fill="none" stroke="{COLOURS[i % len(COLOURS)]}" points="{line(data)}"><title>{escape(str(labels.get(key, "")) if key else "")}</title></polyline>')
    if forecast:
        out.append(f'<polyline fill="none" stroke="#333" stroke-dasharray="4" points="{line(forecast)}"/>')
    out += [f'<circle cx="{x(t):.1f}" cy="{y(v):.1f}" r="4" fill="#d62728"/>' for t, v in anomalies]
    return "".join([*out, "</svg>"])
