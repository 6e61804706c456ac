"""Extension: sessions of users' events, in batches and on streams.

A session is a user's events of which each follows the one before within a gap. On a stream, state is kept for open sessions only:
a watermark, so long behind the latest event, closes sessions that ended before it, which then go out once and leave the state; events that
come later than that are dropped. A batch has all rows at once, and gives the same sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP, LATE = "2 hours", "1 hour"


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user_id, session_start, session_end, n, total, kinds) of events (user_id, ts, event_type, value); a session ends a gap after its last event."""
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL")
    # watermarks are instants: times without a zone are the session's, on the way in and out
    plain = events.isStreaming and events.schema["ts"].dataType.typeName() == "timestamp_ntz"
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if plain else rows
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), kinds.alias("kinds"))
    start, end = (F.col(x).cast("timestamp_ntz") if plain else F.col(x) for x in ("w.start", "w.end"))
    return out.select("user_id", start.alias("session_start"), end.alias("session_end"), "n", "total", "kinds")


def write_sessions(events: DataFrame, out: str, state: str, gap: str = GAP, late: str = LATE) -> StreamingQuery:
    """Start a query that writes the closed sessions of a stream as Parquet; it ends when what is there is read.

    Started again with the same state it goes on: open sessions are kept there, and no session is written twice.
    """
    done = sessions(events, gap, late)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
