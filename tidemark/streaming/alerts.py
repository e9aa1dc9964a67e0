"""The alert state machine over a stream of rule values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "rule_id long, series_key string, event string, at long, value double"
STATE = "state string, triggered_at long"


def advance(state: str, since: int | None, hit: bool, tick: int, duration: int) -> tuple[str, int | None, str | None]:
    """One tick of the machine: (state, triggered_at, event)."""
    if not hit:
        return ("resolved", since, "resolve") if state == "firing" else ("ok", None, None)
    if state == "firing":
        return state, since, None
    since = tick if state == "ok" else since
    fires = duration <= 0 if state in ("ok", "resolved") else tick - since >= duration
    return ("firing", since, "fire") if fires else ("pending", since, None)


def _run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, since = held.get if held.exists else ("ok", None)
    rows = pd.concat(list(batches)).sort_values("tick")
    out = []
    for tick, value, condition, limit, duration in rows[["tick", "value", "condition", "threshold", "duration"]].itertuples(index=False):
        hit = value > limit if condition == "above" else value < limit
        state, since, event = advance(state, None if since is None or since < 0 else int(since), bool(hit), int(tick), int(duration))
        if event:
            out.append((key[0], key[1], event, int(tick), float(value)))
    if state == "ok":
        held.remove() if held.exists else None
    else:
        held.update((state, since))
    yield pd.DataFrame(out, columns=["rule_id", "series_key", "event", "at", "value"])


def events(ticks: DataFrame) -> DataFrame:
    """Fire and resolve events of a stream (rule_id, series_key, tick, value, condition, threshold, duration); state lives between batches."""
    return ticks.groupBy("rule_id", "series_key").applyInPandasWithState(_run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
