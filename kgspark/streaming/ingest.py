"""Notes arriving as files or messages, ingested batch by batch into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import batch_ingest
from ..sources.store import GraphStore


def start_ingest(notes: DataFrame, store: GraphStore, checkpoint: str, clock, trigger: dict | None = None, **kw) -> StreamingQuery:
    """Stream ``notes(user_id, braindump_id, verbatim, payload)`` into the store.

    ``clock(batch_id)`` gives the epoch of a batch. A batch already committed is skipped, so a replay after a failure
    changes nothing.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        done = store.state()["batch"]
        if done is not None and batch_id <= done:
            return
        before = store.tables()
        # A batch is an opaque plan: each use would read all columns of its files again, and its size is not known.
        after, _, _ = batch_ingest(before, batch, clock(batch_id), once=True, **kw)
        changed = {name: df for name, df in after.items() if df is not before.get(name) and name not in after.added}
        store.commit(changed, batch_id, after.added)

    return (
        notes.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
