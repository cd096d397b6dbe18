"""Job states from a stream of events. The reference has no streams: this, its watermark and its late-event rule are additions.

An event that is older than the state is ignored; a state that hears nothing for the time to live, in event time, expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.sources.state import JOB_TTL_S

OUTPUT = "job_id long, seq long, ts timestamp, status string, expired boolean"


def latest_status(events: DataFrame, lateness: str = "10 minutes", ttl_s: int = JOB_TTL_S) -> DataFrame:
    """An update for each job that changes: its latest event, and one with ``expired`` when its time is over. Use output mode "update"."""

    def update(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            seq, us, status = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "seq": [seq], "ts": [pd.Timestamp(us, unit="us")], "status": [status], "expired": [True]})
            return
        best = state.get if state.exists else None
        for pdf in frames:
            for seq, ts, status in zip(pdf["seq"], pdf["ts"], pdf["status"], strict=True):
                us = pd.Timestamp(ts).value // 1000
                if best is None or (us, seq) > (best[1], best[0]):
                    best = (int(seq), int(us), status)
        state.update(best)
        due = best[1] // 1000 + ttl_s * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "seq": [best[0]], "ts": [pd.Timestamp(best[1], unit="us")], "status": [best[2]], "expired": [False]})

    rows = events.withWatermark("ts", lateness).select("job_id", "seq", "ts", "status")
    return rows.groupBy("job_id").applyInPandasWithState(update, OUTPUT, "seq long, us long, status string", "update", GroupStateTimeout.EventTimeTimeout).select("job_id", "seq", F.col("ts"), "status", "expired")
