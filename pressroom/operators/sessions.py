"""Sessions: a user's events with no pause over ``GAP_HOURS``, in batch and as a stream; ordered funnels within them.

Events of one user in one time cell as wide as the gap are always of one session, so each cell is first reduced to its first
and last time and count by a partial aggregation: however many events one user has, a user's window holds at most one row a
cell.  A session is a run of cells whose pauses are at most the gap.

A funnel takes its steps in order: the first event of step 1 in the session, the first of step 2 after it, and so on; order is
by time, then event id.  Each step is one aggregation with map-side combine over the events that can still count, found by an
equi-join on (user, cell), whose other side has each key once; a busy cell is split there by adaptive execution.

As a stream, session windows are kept in state and emitted when the watermark passes their end; events later than that are
dropped.  Rows without a user or time are left out; an empty table gives an empty result; repeated rows count again; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP_HOURS = 6
STEPS = ("view", "click", "purchase")


def _known(events: DataFrame, *more: str) -> DataFrame:
    return events.select("user_id", "ts", *more).where("user_id IS NOT NULL AND ts IS NOT NULL")


def _cell(gap: int) -> Column:
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / gap).alias("cell")


def _cells(events: DataFrame, gap_hours: int) -> DataFrame:
    """user_id, cell, a, b, n, session: each cell with the number of its session in the user's order."""
    gap = gap_hours * 3600
    cells = (_known(events).groupBy("user_id", _cell(gap))
             .agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")))
    order = Window.partitionBy("user_id").orderBy("cell")  # a row a cell
    pause = F.unix_micros(F.col("a").cast("timestamp")) - F.unix_micros(F.lag("b").over(order).cast("timestamp"))
    first = F.when(pause <= gap * 1_000_000, 0).otherwise(1)
    return cells.withColumn("new", first).withColumn("session", F.sum("new").over(order)).drop("new")


def sessions(events: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """user_id, session (1, 2, ... by time), start, last, n."""
    return (_cells(events, gap_hours).groupBy("user_id", "session")
            .agg(F.min("a").alias("start"), F.max("b").alias("last"), F.sum("n").alias("n")))


def stream_sessions(events: DataFrame, out: str, checkpoint: str, late: str = "2 hours", gap_hours: int = GAP_HOURS,
                    trigger: dict | None = None) -> StreamingQuery:
    """user_id, start, last, n of a stream's sessions, appended to the Parquet folder ``out`` when they end."""
    timed = _known(events).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = (timed.groupBy("user_id", F.session_window("at", f"{gap_hours} hours").alias("w"))
             .agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w"))
    return (found.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def funnel(events: DataFrame, steps: tuple = STEPS, gap_hours: int = GAP_HOURS, type_col: str = "event_type") -> DataFrame:
    """user_id, session, reached (how many steps, in order), step_1 ... step_k: when each was first reached, NULL if not."""
    gap = gap_hours * 3600
    cells = _cells(events, gap_hours).select("user_id", "cell", "session").checkpoint()
    at = _known(events, "event_id", F.col(type_col).alias("type")).where(F.col("type").isin(*steps))
    at = at.select("user_id", _cell(gap), "type", F.struct("ts", "event_id").alias("place"))
    out = cells.select("user_id", "session").distinct()
    left = cells  # of the sessions still on their way
    for k, step in enumerate(steps, 1):
        after = F.col("place") > F.col("since") if k > 1 else F.lit(True)
        got = (at.where(F.col("type") == step).join(left, ["user_id", "cell"]).where(after)
               .groupBy("user_id", "session").agg(F.min("place").alias("since"))).checkpoint()
        left = cells.join(got, ["user_id", "session"])
        out = out.join(got.select("user_id", "session", F.col("since.ts").alias(f"step_{k}")), ["user_id", "session"], "left")
    times = [F.col(f"step_{k}") for k in range(1, len(steps) + 1)]
    reached = sum((t.isNotNull().cast("int") for t in times), F.lit(0))
    return out.select("user_id", "session", reached.alias("reached"), *times)
