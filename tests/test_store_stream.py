"""Change log (S3/S4), snapshot (S6), schema evolution (M1-M3), run ledger
and the streaming ingest (S2, W1-W4)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.operators import ledger as LG
from pressroom.operators import schema as SC
from pressroom.operators.articles import ARTICLE_COLUMNS
from pressroom.plans import catalog as C
from pressroom.plans import fixtures as FX
from pressroom.plans.ingest import check_source, ingest
from pressroom.session import scratch_path
from pressroom.sources import store as ST
from pressroom.operators import upsert as UP

from conftest import SF_SMALL

NOW = dt.datetime(2024, 2, 1)


def write_page_drops(spark, sf_dir: str, drops_dir: str, n_drops: int) -> None:
    """The pages as ``n_drops`` files of consecutive page_id ranges, one after the other."""
    pages = C._pages(spark, sf_dir)
    b = pages.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    step = (b["hi"] - b["lo"]) // n_drops + 1
    for k in range(n_drops):
        lo = b["lo"] + k * step
        part = pages.filter((F.col("page_id") >= lo) & (F.col("page_id") < lo + step))
        part.coalesce(1).write.mode("append").parquet(drops_dir)


def _rows(df):
    return sorted(tuple(r[c] for c in ARTICLE_COLUMNS) for r in df.select(*ARTICLE_COLUMNS).collect())


def test_changelog_replay_is_idempotent_and_as_of(spark):
    path = scratch_path(spark, "t-articles")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    v1 = _rows(ST.read_articles(spark, path))
    changed = a.limit(5).withColumn("perex", F.lit("changed"))
    ST.write_changes(changed, path, 2)
    ST.write_changes(changed, path, 2)
    latest = ST.read_articles(spark, path)
    assert latest.count() == len(v1)
    assert latest.filter(F.col("perex") == "changed").count() == 5
    assert _rows(ST.read_articles(spark, path, as_of_batch=1)) == v1
    ST.compact(spark, path)
    assert _rows(ST.read_articles(spark, path)) == _rows(latest)
    assert ST.next_batch_id(spark, path) == 3


def test_snapshot_missing_table_returns_none(spark):
    assert ST.snapshot_table(spark, scratch_path(spark, "nothing-here")) is None


def test_schema_evolution(spark):
    df = FX.legacy_articles(spark, SF_SMALL, "missing")
    df2, added = SC.add_column_if_missing(df, "title_hash", T.StringType())
    assert added and "title_hash" in df2.columns
    _, again = SC.add_column_if_missing(df2, "title_hash", T.StringType())
    assert not again
    m1, changed1 = SC.migrate_v2(df, NOW)
    m2, changed2 = SC.migrate_v2(m1, NOW)
    assert changed1 and not changed2
    assert _rows(m1) == _rows(m2)
    assert SC.migrate_v2(None, NOW) == (None, False)


def test_ledger_lifecycle(spark):
    t = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    rows = [(1, t, 1, "pending", "scrape_all", None, None, None), (1, t + h, 2, "running", "scrape_all", None, None, None),
            (1, t + 2 * h, 3, "completed", "scrape_all", None, 12, None),
            (2, t, 4, "pending", "periodic_scrape", None, None, None), (2, t + h, 5, "running", "periodic_scrape", None, None, None),
            (2, t + 2 * h, 6, "failed", "periodic_scrape", None, None, "Timeout"),
            (2, t + 3 * h, 7, "running", "periodic_scrape", None, None, None),
            (3, t, 8, "pending", "scrape_source", "ct24", None, None)]
    st = {r["run_id"]: r for r in LG.run_state(LG.run_events(spark, rows)).collect()}
    assert (st[1]["status"], st[1]["articles_scraped"], st[1]["progress"]) == ("completed", 12, 1.0)
    assert (st[2]["status"], st[2]["error"], st[2]["error_class"], st[2]["completed_at"]) == (
        "running", "Timeout", "timeout", t + 2 * h)
    assert (st[3]["status"], st[3]["source"], st[3]["articles_scraped"], st[3]["started_at"]) == (
        "pending", "ct24", None, None)
    state = LG.run_state(LG.run_events(spark, rows))
    assert LG.running_runs(state).count() == 1
    assert LG.run_by_id(state, 99).count() == 0
    kept = {r["run_id"] for r in LG.purge_runs(state, t + 27 * h, 24).collect()}
    assert kept == {2, 3}


def test_unknown_source_rejected_on_driver(spark):
    import pytest
    with pytest.raises(ValueError):
        check_source("nope")
    check_source("ct24")


def test_stream_equals_one_batch_and_replay(spark):
    from pressroom.streaming.ingest_stream import make_batch_writer, stream_ingest
    drops = scratch_path(spark, "t-drops")
    table = scratch_path(spark, "t-table")
    ledger = scratch_path(spark, "t-ledger")
    write_page_drops(spark, SF_SMALL, drops, 2)
    ckpt = scratch_path(spark, "t-ckpt")
    q = stream_ingest(spark, drops, table, ckpt, trigger="now",
                      max_files_per_trigger=1, clock=lambda: NOW, ledger_path=ledger, fallback="page")
    q.awaitTermination(600)
    assert q.exception() is None
    assert ST.batches(spark, table) == [1, 2]
    streamed = _rows(ST.read_articles(spark, table))
    one = ingest(C._pages(spark, SF_SMALL), UP.empty_articles(spark), NOW, fallback="page").upsert.table
    assert streamed == _rows(one)
    assert ST.max_id(spark, table) == max(r[0] for r in streamed)   # recorded, not scanned
    # replay epoch 1 (batch 2) with the same input: nothing changes
    second = spark.read.parquet(drops).orderBy("page_id")
    files = sorted(spark.read.parquet(drops).inputFiles(),
                   key=lambda f: spark.read.parquet(f).agg(F.min("page_id")).first()[0])
    replay = spark.read.parquet(files[1])
    make_batch_writer(table, clock=lambda: NOW, fallback="page", stream=ckpt)(replay, 1)
    assert _rows(ST.read_articles(spark, table)) == streamed
    runs = LG.run_state(LG.read_events(spark, ledger)).collect()
    assert {r["status"] for r in runs} == {"completed"} and len(runs) == 2
    assert second.count() > 0


def test_periodic_trigger_coalesces_missed_runs(spark):
    """W1 + W3: drops that piled up while no trigger fired are taken by one run;
    maxFilesPerTrigger bounds a catch-up run."""
    from pressroom.streaming.ingest_stream import stream_ingest
    for max_files, expected in ((None, [1]), (2, [1, 2])):
        drops = scratch_path(spark, "t-drops")
        table = scratch_path(spark, "t-table")
        write_page_drops(spark, SF_SMALL, drops, 3)
        q = stream_ingest(spark, drops, table, scratch_path(spark, "t-ckpt"), trigger="periodic", period="1 second",
                          max_files_per_trigger=max_files, clock=lambda: NOW, compact_every=1,
                          fallback="page")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert ST.batches(spark, table) == expected
        assert ST.bases(spark, table) == expected   # compacted after each batch
        one = ingest(C._pages(spark, SF_SMALL), UP.empty_articles(spark), NOW, fallback="page").upsert.table
        assert _rows(ST.read_articles(spark, table)) == _rows(one)


def test_migrate_store_writes_only_when_changed(spark):
    legacy = scratch_path(spark, "t-legacy")
    FX.legacy_articles(spark, SF_SMALL, "blank").write.parquet(legacy)
    store = scratch_path(spark, "t-store")
    assert SC.migrate_store(spark, store, NOW, legacy_path=scratch_path(spark, "t-missing")) is None
    assert SC.migrate_store(spark, store, NOW, legacy_path=legacy) == 1
    assert SC.migrate_store(spark, store, NOW) is None          # already v2: no new version
    # a row losing its hash later is backfilled as a one-row batch
    row = ST.read_articles(spark, store).filter(F.col("title") != "").limit(1).withColumn(
        "title_hash", F.lit(None).cast("string"))
    ST.write_changes(row, store, 2)
    assert SC.migrate_store(spark, store, NOW) == 3
    assert ST.read_articles(spark, store).filter(
        (F.col("title") != "") & F.col("title_hash").isNull()).count() == 0
    assert spark.read.parquet(store + "/log/batch_id=3").count() == 1


def test_arrival_order_follows_fetch_time_then_rank_then_page(spark):
    """seq orders candidates by (fetched_at, registry rank, page_id, pos)."""
    from pressroom.plans.ingest import candidates
    t = dt.datetime(2024, 1, 1)
    html = ('<article><h2><a href="/a/{0}">Headline number {0} here</a></h2></article>'
            '<article><h2><a href="/b/{0}">Second headline {0} here</a></h2></article>')
    pages = spark.createDataFrame(
        [(10, "listing", "s1", "https://s1.x", "https://s1.x/", html.format(10), t + dt.timedelta(hours=2), 0),
         (20, "listing", "s2", "https://s2.x", "https://s2.x/", html.format(20), t, 1),
         (30, "listing", "s3", "https://s3.x", "https://s3.x/", html.format(30), t, 0)],
        "page_id long, profile string, source string, base_url string, url string, html string, "
        "fetched_at timestamp_ntz, source_rank int")
    items, _, _ = candidates(pages, fetched_at_col="fetched_at")
    got = [(r["page_id"], r["pos"]) for r in items.orderBy("seq").collect()]
    assert got == [(30, 0), (30, 1), (20, 0), (20, 1), (10, 0), (10, 1)]
    assert [r["seq"] for r in items.orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]


def test_half_written_batches_are_not_read(spark):
    path = scratch_path(spark, "t-articles")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    before = _rows(ST.read_articles(spark, path))
    # what runs that died before their commit row leave behind
    a.limit(3).write.parquet(f"{path}/base/upto=1")
    a.limit(7).withColumn("perex", F.lit("half")).write.parquet(f"{path}/log/batch_id=2")
    assert _rows(ST.read_articles(spark, path)) == before and ST.next_batch_id(spark, path) == 2
    ST.write_changes(a.limit(4).withColumn("perex", F.lit("new")), path, 2)
    assert ST.read_articles(spark, path).filter("perex = 'new'").count() == 4
    ST.write_changes(a.limit(0), path, 2)   # an empty replay empties the batch
    assert _rows(ST.read_articles(spark, path)) == before


def test_source_filter_reaches_the_log_scan(spark):
    path = scratch_path(spark, "t-articles")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    plan = ST.read_articles(spark, path, source="src1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan


def test_second_stream_gets_its_own_batches(spark):
    path = scratch_path(spark, "t-articles")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    assert ST.next_batch_id(spark, path, "s1", 0) == 2
    ST.write_changes(a.limit(1), path, 2, stream="s1", epoch=0)
    assert ST.next_batch_id(spark, path, "s2", 0) == 3
    assert ST.next_batch_id(spark, path, "s1", 0) == 2


def test_bad_pages_and_null_fetch_times(spark):
    from pressroom.plans.ingest import candidates
    html = '<article><h2><a href="/a">Headline number one here</a></h2></article>'
    pages = spark.createDataFrame(
        [(2**60 + 1, "listing", "s1", "https://s1.x", "https://s1.x/", html, dt.datetime(2024, 1, 1), 0),
         (5, "listing", "s2", "https://s2.x", "https://s2.x/", html, None, 0),
         (None, "listing", "s3", "https://s3.x", "https://s3.x/", html, None, 0),
         (7, "listing", "s4", "https://s4.x", "https://s4.x/", None, None, 0)],
        "page_id long, profile string, source string, base_url string, url string, html string, "
        "fetched_at timestamp_ntz, source_rank int")
    items, _, quarantine = candidates(pages, fetched_at_col="fetched_at")
    assert [(r.seq, r.page_id) for r in items.orderBy("seq").collect()] == [(1, 5), (2, 2**60 + 1)]
    assert {r.source for r in quarantine.collect()} >= {"s3"}


def test_summary_of_an_empty_run_has_a_total(spark):
    none = spark.createDataFrame([], "seq long, source string, outcome string, id long")
    assert [tuple(r) for r in UP.ingest_summary(none).collect()] == [(None, 0, 0, 0, 0)]
