"""Ingest runs (S8, S9): pages -> extraction -> validity gate -> keyed items ->
upsert -> changes + per-source summary.

All sources go through one plan with ``source`` as a column (no per-source union);
a bad page or element is quarantined instead of failing the run; the whole batch is
committed at once by the caller (``write_changes``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.operators.extract import extract_raw, split_raw
from pressroom.operators.upsert import UpsertResult, dense_rank_by, ingest_summary, upsert_articles
from pressroom.session import checkpoint_dir, spread
from pressroom.sources.pages import assign_source
from pressroom.sources.profiles import profiles_df, source_names


@dataclass
class IngestResult:
    upsert: UpsertResult
    items: DataFrame
    rejects: DataFrame
    quarantine: DataFrame

    @property
    def summary(self) -> DataFrame:
        return ingest_summary(self.upsert.outcomes)


def check_source(source: str | None, valid_sources=None):
    """A single-source run must name a known source (checked on the driver before
    any plan runs).  Known = every registered
    source, plug-ins included, unless the caller names the set, as a
    list or as a DataFrame with a ``source`` column (checked with a 1-row probe)."""
    if source is None:
        return
    if isinstance(valid_sources, DataFrame):
        ok = valid_sources.filter(F.col("source") == source).limit(1).count() > 0
    else:
        ok = source in (source_names() if valid_sources is None else list(valid_sources))
    if not ok:
        raise ValueError(f"Unknown source: {source}")


def candidates(pages: DataFrame, source: str | None = None, fallback: str | None = None,
               fetched_at_col: str | None = None, profiles=None, extractors=None, use_cap: bool = False):
    """Extraction for a run; with ``source`` only that source's pages are parsed (the
    filter sits before the Python stage).  Pages that already carry ``profile``,
    ``source`` and ``base_url`` skip the registry join.  Adds the arrival order
    ``seq``: (fetched_at, registry rank of the source, page_id, pos)."""
    spark = pages.sparkSession
    pages = spread(pages)   # a micro-batch of one file is one split: parse it on all cores
    if {"profile", "source", "base_url"} <= set(pages.columns):
        assigned = pages if "source_rank" in pages.columns else pages.withColumn("source_rank", F.lit(0))
    else:
        assigned = assign_source(pages, profiles_df(spark), fallback=fallback)
    if source is not None:
        assigned = assigned.filter(F.col("source") == source)
    order_cols = ([fetched_at_col] if fetched_at_col else []) + ["source_rank", "page_id", "pos"]
    keep_cols = ["source_rank"] + ([fetched_at_col] if fetched_at_col else [])
    # the HTML stage is the expensive part: write its output once, so articles, rejects
    # and quarantine all come from one parse of the pages
    checkpoint_dir(spark)
    raw = extract_raw(assigned, profiles, extractors, carry=keep_cols, use_cap=use_cap).checkpoint()
    arts, rejects, quarantine = split_raw(raw, carry=keep_cols)
    items = dense_rank_by(arts, order_cols, "seq")
    return items.select("seq", "page_id", "pos", "title", "perex", "source", "url", "title_hash"), rejects, quarantine


def ingest(pages: DataFrame, existing: DataFrame, batch_time, source: str | None = None,
           fallback: str | None = None, fetched_at_col: str | None = None,
           valid_sources=None, max_id: int | None = None, profiles=None, extractors=None,
           use_cap: bool = False) -> IngestResult:
    """One ingest run over stored pages against the current table."""
    check_source(source, valid_sources)
    items, rejects, quarantine = candidates(pages, source, fallback, fetched_at_col, profiles, extractors, use_cap)
    res = upsert_articles(existing, items, batch_time, max_id=max_id)
    return IngestResult(upsert=res, items=items, rejects=rejects, quarantine=quarantine)
