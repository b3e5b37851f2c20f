"""Run ledger (R1-R6): an append-only table of run lifecycle events; the current
state of a run is derived by one aggregation, never updated in place.

Event columns: run_id, ts, event_id, status, task_type, source (of a single-source run),
n (articles scraped, on 'completed'), message (error text, on 'failed').  State per run, as the reference's
task record evolves:

* status        of the latest event by (ts, event_id);
* created_at    first event;
* started_at    latest 'running' event (a periodic run restarts it);
* completed_at  latest terminal event (not cleared by a later restart);
* result        {"articles_scraped": n} of the latest 'completed' event, NULL if none;
* error         message of the latest 'failed' event, and its class;
* progress      1.0 once a run has completed.

``groupBy(run_id)`` with max(struct(ts, event_id, value)) aggregates combine
map-side, so a run with millions of events costs one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.functions.text import batch_timestamp, classify_error

# --- fixed values ----------------------------------------------------------------------
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
TERMINAL = (COMPLETED, FAILED, CANCELLED)
TASK_TYPES = ("scrape_all", "scrape_source", "periodic_scrape")
DEFAULT_MAX_AGE_HOURS = 24
# ---------------------------------------------------------------------------------------

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("message", T.StringType()),
])


def _latest(value, cond=None):
    """Value of the latest (ts, event_id) event, optionally among events meeting
    ``cond``."""
    s = F.struct(F.col("ts"), F.col("event_id"), value.alias("v"))
    return F.max(s if cond is None else F.when(cond, s))["v"]


def run_state(events: DataFrame) -> DataFrame:
    """Current state of every run."""
    st = F.col("status")
    return events.groupBy("run_id").agg(
        _latest(st).alias("status"),
        _latest(F.col("task_type")).alias("task_type"),
        F.min("ts").alias("created_at"),
        F.max(F.when(st == RUNNING, F.col("ts"))).alias("started_at"),
        F.max(F.when(st.isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        _latest(F.col("source")).alias("source"),
        _latest(F.col("n"), st == COMPLETED).cast("bigint").alias("articles_scraped"),
        _latest(F.col("message"), st == FAILED).alias("error"),
        F.when(F.count_if(st == FAILED) > 0, classify_error(F.coalesce(
            _latest(F.col("message"), st == FAILED), F.lit("")))).alias("error_class"),
        F.when(F.count_if(st == COMPLETED) > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("progress"),
    )


def _with_total(df: DataFrame) -> DataFrame:
    """Attach the row count (one scalar, counted once, like the reference's len())."""
    return df.withColumn("total", F.lit(df.count()).cast("bigint"))


def list_runs(state: DataFrame) -> DataFrame:
    """R2: all runs, each row carrying the total."""
    return _with_total(state)


def running_runs(state: DataFrame) -> DataFrame:
    """Runs whose status is 'running', with their count."""
    return _with_total(state.filter(F.col("status") == RUNNING))


def runs_by_type(state: DataFrame, task_type: str) -> DataFrame:
    """Runs of one task type."""
    if task_type not in TASK_TYPES:
        raise ValueError(f"unknown task type: {task_type}")
    return state.filter(F.col("task_type") == task_type)


def run_by_id(state: DataFrame, run_id) -> DataFrame:
    """One run, empty when unknown."""
    return state.filter(F.col("run_id") == F.lit(run_id))


def purge_runs(state: DataFrame, now, max_age_hours: int = DEFAULT_MAX_AGE_HOURS) -> DataFrame:
    """Drop terminal runs whose completed_at is strictly older than now - max_age;
    everything else (including terminal runs without completed_at) is kept."""
    cutoff = batch_timestamp(now) - F.make_dt_interval(F.lit(0), F.lit(int(max_age_hours)), F.lit(0), F.lit(0))
    drop = F.col("status").isin(*TERMINAL) & F.col("completed_at").isNotNull() & (F.col("completed_at") < cutoff)
    return state.filter(~F.coalesce(drop, F.lit(False)))


def run_events(spark, rows) -> DataFrame:
    """A few events (one run's lifecycle) as a DataFrame, to append to the ledger."""
    return spark.createDataFrame(rows, RUN_EVENT_SCHEMA)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only ledger write, partitioned by event date."""
    (events.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").parquet(path))


def read_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in RUN_EVENT_SCHEMA.fields])
