"""Alerts on growing error counters, outages and a threshold, each with a cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

COOLDOWN_SECONDS = 3600
CAPACITY_PCT = 85
OUTPUT = "source string, t bigint, alert string, previous bigint, current bigint"
STATE = "last_count bigint, down boolean, down_at bigint, growth_at bigint, level_at bigint"
_LONG_AGO = -(1 << 40)
FRESH = (0, False, _LONG_AGO, _LONG_AGO, _LONG_AGO)


def step(state: tuple, t: int, reachable: bool, count: int, pct: int, cooldown: int, capacity: int):
    """State after one sample and the alerts it raises (``kind, previous, current``)."""
    last, down, down_at, growth_at, level_at = state
    out = []
    if not reachable:
        down = True
        if t - down_at >= cooldown:
            out.append(("down", last, last))
            down_at = t
    else:
        # The first sample after an outage only sets the new base.
        if not down and count > last and t - growth_at >= cooldown:
            out.append(("growth", last, count))
            growth_at = t
        last, down = count, False
    if pct > capacity and t - level_at >= cooldown:
        out.append(("level", pct, capacity))
        level_at = t
    return (last, down, down_at, growth_at, level_at), out


def _walk(source, rows: pd.DataFrame, state: tuple, cooldown: int, capacity: int):
    found = []
    for row in rows.sort_values("t").itertuples():
        state, alerts = step(
            state, int(row.t), bool(row.reachable), int(row.sync_error_count), int(row.volume_pct), cooldown, capacity
        )
        found += [(source, int(row.t), kind, int(a), int(b)) for kind, a, b in alerts]
    return state, pd.DataFrame(found, columns=["source", "t", "alert", "previous", "current"])


def alerts(samples: DataFrame, cooldown: int = COOLDOWN_SECONDS, capacity: int = CAPACITY_PCT) -> DataFrame:
    """Alerts of a stream of ``samples(source, t, reachable, sync_error_count, volume_pct)``, state kept per source."""

    def fold(key, frames: Iterator[pd.DataFrame], state):
        rows = pd.concat(list(frames))
        held = state.get if state.exists else FRESH
        held, found = _walk(key[0], rows, tuple(held), cooldown, capacity)
        state.update(held)
        yield found

    return samples.groupBy("source").applyInPandasWithState(
        fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
