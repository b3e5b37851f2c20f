"""Structured Streaming ingest.

``readStream`` over a folder of page snapshot drops -> ``foreachBatch`` running one
ingest per micro-batch against the article table as of the previous batch -> commit
of the batch's changed rows under a batch number that the table allots.

* W1 periodic ingest: ``trigger(processingTime="2 hours")``.
* W2 run-now ingest of everything pending: ``trigger(availableNow=True)``; optional
  single-source filter (S9 check first).
* W3 missed runs coalesce: a late processing-time trigger fires once and takes all
  new files; ``maxFilesPerTrigger`` bounds a catch-up batch.
* W4 state across runs: the upsert reads the table state written by earlier batches;
  there is no watermark (an article stays matchable forever) and no
  ``transformWithState`` (a component of the upsert crosses any single grouping key).

Exactly-once: the commit row of a batch names its stream (by the checkpoint folder) and
epoch.  A replayed epoch finds its own number, reads the table as of the batch before
and rewrites the same rows; an epoch of another stream, or a first run into a table
that has other batches, gets the next number.  Rejects and quarantined pages are written
beside the batch, from the same parse.  A single-source run reads only that source's
pages under its own checkpoint; other streams' checkpoints still have them to read.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.operators import ledger as LG
from pressroom.plans.ingest import check_source, ingest
from pressroom.sources import store as ST
from pressroom.sources.pages import stream_pages

# --- fixed values ----------------------------------------------------------------------
PERIOD = "2 hours"
# ---------------------------------------------------------------------------------------


def _utcnow():
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def make_batch_writer(table_path: str, source: str | None = None, clock=_utcnow,
                      ledger_path: str | None = None, task_type: str = "periodic_scrape",
                      fallback: str | None = None, valid_sources=None, compact_every: int | None = None,
                      stream: str = "stream", profiles=None, extractors=None):
    """The ``foreachBatch`` function: ingest one micro-batch and commit it; every
    ``compact_every`` batches the log is folded into a new base, so the next read
    aggregates only the batches after it."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch_id = ST.next_batch_id(spark, table_path, stream, int(epoch_id))
        started = clock()
        n_new, status, msg = None, LG.COMPLETED, None
        try:
            existing = ST.read_articles(spark, table_path, as_of_batch=batch_id - 1)
            res = ingest(batch, existing, started, source=source, fallback=fallback,
                         valid_sources=valid_sources, max_id=ST.max_id(spark, table_path, batch_id - 1),
                         profiles=profiles, extractors=extractors)
            for name, rows in (("rejects", res.rejects), ("quarantine", res.quarantine)):
                rows.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/{name}/batch_id={batch_id}")
            ST.write_changes(res.upsert.changes.checkpoint(), table_path, batch_id, max_id=res.upsert.max_id,
                             stream=stream, epoch=int(epoch_id))
            n_new = res.upsert.outcomes.filter(F.col("outcome") == "inserted").count()
        except Exception as exc:  # noqa: BLE001 - record the failed run, then re-raise
            status, msg = LG.FAILED, f"{type(exc).__name__}: {exc}"
            raise
        finally:
            if ledger_path:
                _log_run(spark, ledger_path, task_type, source, started, clock(), status, n_new, msg)
        if compact_every and batch_id % compact_every == 0:
            ST.compact(spark, table_path)

    return write_batch


def _log_run(spark, path, task_type, source, started, ended, status, n, msg):
    run_id = uuid.uuid4().int >> 65   # a fresh id per attempt: 63 random bits
    rows = [(run_id, started, 1, LG.RUNNING, task_type, source, None, None),
            (run_id, ended, 2, status, task_type, source, n, msg)]
    LG.append_events(LG.run_events(spark, rows), path)


def stream_ingest(spark: SparkSession, pages_dir: str, table_path: str, checkpoint_location: str, *,
                  trigger: str = "periodic", source: str | None = None, max_files_per_trigger: int | None = None,
                  clock=_utcnow, ledger_path: str | None = None, fallback: str | None = None,
                  valid_sources=None, period: str = PERIOD, compact_every: int | None = None,
                  profiles=None, extractors=None):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``trigger``: "periodic" (W1, every ``period``, 2 hours by default) or "now" (W2,
    everything pending, then stop)."""
    check_source(source, valid_sources)  # S9: fail on the driver before the stream starts
    pages = stream_pages(spark, pages_dir, max_files_per_trigger)
    w = (pages.writeStream
         .foreachBatch(make_batch_writer(table_path, source, clock, ledger_path,
                                         "periodic_scrape" if trigger == "periodic" else
                                         ("scrape_source" if source else "scrape_all"), fallback,
                                         valid_sources, compact_every, checkpoint_location, profiles, extractors))
         .option("checkpointLocation", checkpoint_location))
    if trigger == "periodic":
        w = w.trigger(processingTime=period)
    elif trigger == "now":
        w = w.trigger(availableNow=True)
    else:
        raise ValueError(f"unknown trigger {trigger!r}")
    return w.start()
