"""Retry state per note, kept across restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schema import RETRY_INTERVAL_SECONDS

OUTPUT = "user_id string, braindump_id bigint, ingest_status string, ingest_attempts int, last_attempt_at bigint, retry_due boolean"
STATE = "ingest_status string, ingest_attempts int, last_attempt_at bigint"


def retry_states(attempts: DataFrame, interval: int = RETRY_INTERVAL_SECONDS, timeouts: bool = True) -> DataFrame:
    """Fold ``attempts(user_id, braindump_id, attempt, outcome, attempted_at)`` into a status per note.

    A transient failure keeps the note pending and arms a timer; when it runs out a ``retry_due`` row is emitted. A
    final status is never left again.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state):
        status, tries, last = state.get if state.exists else ("pending", 0, -1)
        due = state.hasTimedOut
        for frame in () if due else frames:
            for row in frame.sort_values("attempt").itertuples():
                if status != "pending":
                    break
                tries, last = int(row.attempt), int(row.attempted_at)
                if row.outcome != "transient":
                    status = row.outcome
        state.update((status, tries, last))
        if timeouts and status == "pending":
            state.setTimeoutDuration(interval * 1000)
        yield pd.DataFrame(
            {
                "user_id": [key[0]], "braindump_id": [key[1]], "ingest_status": [status], "ingest_attempts": [tries],
                "last_attempt_at": [last], "retry_due": [bool(due and status == "pending")],
            }
        )

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeouts else GroupStateTimeout.NoTimeout
    return attempts.groupBy("user_id", "braindump_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", timeout)
