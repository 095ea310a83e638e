"""File events as a stream: quiet periods, a longest wait, the last event of each path, and batches applied in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_SECONDS, LONGEST_SECONDS = 5, 30


def debounced(events: DataFrame, quiet: int = QUIET_SECONDS, late: int = 60) -> DataFrame:
    """events (path, kind, ts) to the last event of each burst: a burst of a path ends after a quiet period."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = marked.withWatermark("ts", f"{late} seconds") if events.isStreaming else marked
    session = F.session_window("ts", f"{quiet} seconds")
    return marked.groupBy("path", session.alias("w")).agg(F.max_by("kind", "ts").alias("kind"), F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last")).select("path", "kind", "n_events", "last")


def bounded(events: DataFrame, quiet: int = QUIET_SECONDS, longest: int = LONGEST_SECONDS) -> DataFrame:
    """As debounced, but a burst that goes on is emitted after the longest wait. The state of a path is three numbers and its last kind."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, kind, n = state.get if state.exists else (None, None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], kind, n, last))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for ts, k in zip(rows["ts"].astype("int64") // 10**6 if rows["ts"].dtype != object else rows["ts"], rows["kind"], strict=True):
                if first is not None and (ts - last > 1000 * quiet or ts - first >= 1000 * longest):
                    out.append((key[0], kind, n, last))
                    first, n = None, 0
                first, last, kind, n = ts if first is None else first, ts, k, n + 1
            state.update((first, last, kind, n))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(last + 1000 * quiet, first + 1000 * longest)))
        yield pd.DataFrame(out, columns=["path", "kind", "n_events", "last_ms"])

    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{quiet} seconds")
    timed = marked.select("path", "kind", F.unix_millis("ts").alias("ms"), "ts")
    return timed.groupBy("path").applyInPandasWithState(lambda k, b, s: run(k, (x.assign(ts=x["ms"].astype(object)) for x in b), s), "path string, kind string, n_events long, last_ms long", "first long, last long, kind string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def apply_in_order(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs apply(batch, number) for one batch after the other, so graph updates never overlap."""
    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()
