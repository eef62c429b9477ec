"""Session gates over a stream: arrival order is ``seq``; state per session and mode, cleared when the session ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, seq long, mode string, content string, emitted boolean"


def first_emission_stream(events: DataFrame) -> DataFrame:
    """Streaming form of the batch operator. State is one digest per mode of a session, so it is bounded by open sessions."""
    named = events.select(F.coalesce(F.nullif("session_id", F.lit("")), F.lit("nosession")).alias("session_id"), F.col("seq").cast("long").alias("seq"), "mode", "content")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib
        import json

        last = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if r.mode == "session-end":
                last = {}
                continue
            digest = hashlib.sha256((r.content or "").encode()).hexdigest()
            out.append((key[0], r.seq, r.mode, r.content, last.get(r.mode) != digest))
            last[r.mode] = digest
        if last:
            state.update((json.dumps(last),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "seq", "mode", "content", "emitted"])

    return named.groupBy("session_id").applyInPandasWithState(step, OUT, "digests string", "append", GroupStateTimeout.NoTimeout)


def once_per_session_stream(events: DataFrame, *key: str) -> DataFrame:
    """First event of each session and key; ends of sessions are not seen here, watermarks may bound the state."""
    named = events.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.lit("nosession")))
    return named.dropDuplicates(["session_id", *(key or ("mode",))])
