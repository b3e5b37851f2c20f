"""What the change-log store and the upsert leave on disk and move (findings of round 4)."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from pressroom.operators import upsert as UP
from pressroom.operators.articles import ARTICLE_COLUMNS
from pressroom.plans import catalog as C
from pressroom.plans import fixtures as FX
from pressroom.session import scratch_path, shuffles_freed, written
from pressroom.sources import store as ST

from conftest import SF_SMALL

BATCH = C.BATCH_TIME


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _store(spark, few_ids_changed: bool = True):
    """A compacted table with a later batch, and the rows that a reader must see."""
    path = scratch_path(spark, "t-disk")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    ST.compact(spark, path)
    hit = F.col("id") % 7 == 0 if few_ids_changed else F.col("id") % 7 != 0
    ST.write_changes(a.filter(hit).withColumn("perex", F.lit("changed")), path, 2)
    return path, a.withColumn("perex", F.when(hit, "changed").otherwise(F.col("perex")))


def _exchanged(df) -> list[str]:
    """The columns of every shuffle in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
                                                  .fromString("formatted"))
    return re.findall(r"^\(\d+\) Exchange\s*\nInput \[\d+\]: (.*)$", plan, re.M)


def test_a_compacted_table_is_read_without_a_join(spark):
    path = scratch_path(spark, "t-disk")
    a = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    ST.write_changes(a, path, 1)
    ST.compact(spark, path)
    read = ST.read_articles(spark, path)
    assert _exchanged(read) == []
    assert "Join" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(read) == _rows(a)


@pytest.mark.parametrize("few_ids_changed", [True, False])
def test_later_batches_are_laid_over_a_base_without_moving_texts(spark, few_ids_changed, monkeypatch):
    path, want = _store(spark, few_ids_changed)
    want = _rows(want)
    # few ids change, few are kept, and neither (then the texts must be dealt)
    for few, moved in ((100, False), (0, True)):
        monkeypatch.setattr(ST, "FEW_IDS", few)
        was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            read = ST.read_articles(spark, path)
            assert any("title" in columns for columns in _exchanged(read)) == moved
            assert _rows(read) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_null_id_of_the_base_is_kept(spark, monkeypatch):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, title string")
    ids = spark.createDataFrame([(1,), (5,), (6,)], "id long")
    for few in (10, 2, 0):
        monkeypatch.setattr(ST, "FEW_IDS", few)
        assert sorted(r.title for r in ST._not_in(base, ids).collect()) == ["b", "c"]


@pytest.mark.parametrize("items, few", [(FX.batch_mixed, 0), (C._v2_items, UP.FEW_KEYS), (C._v2_items, 0)])
def test_lean_upsert_gives_the_same_changes(spark, items, few, monkeypatch):
    monkeypatch.setattr(UP, "FEW_KEYS", few)
    batch = items(spark, SF_SMALL)
    table = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS).filter("id % 3 < 2")
    plain = UP.upsert_articles(table, batch, BATCH)
    lean = UP.upsert_articles(table, batch, BATCH, lean=True)
    assert _rows(lean.changes) == _rows(plain.changes)
    assert _rows(lean.table) == _rows(plain.table)
    assert _rows(lean.outcomes) == _rows(plain.outcomes)
    assert lean.max_id == plain.max_id


def test_written_in_lots_is_the_same(spark):
    df = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.col("id").alias("x"))
    df = df.join(spark.range(0, 2000, 2).withColumnRenamed("id", "x"), "x")
    assert _rows(written(df, "t-lots", lots=4)) == _rows(df)


def test_shuffles_are_gone_when_a_table_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    df = FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS)
    before = _shuffle_files(spark)
    out = written(df.repartition(3, "source"), "t-written")
    path = scratch_path(spark, "t-disk")
    ST.write_changes(df.repartition(3, "source"), path, 1)
    ST.compact(spark, path)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(key) == was
    assert _rows(out) == _rows(df) == _rows(ST.read_articles(spark, path))
    with pytest.raises(ZeroDivisionError):
        with shuffles_freed(spark):
            1 / 0
    assert spark.conf.get(key) == was


def _shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*", recursive=True)}


def test_texts_of_the_store_are_written_with_zstd(spark):
    import pyarrow.parquet as pq
    path, _ = _store(spark)
    files = [f for part in ("log/batch_id=1", "log/batch_id=2", "base/upto=1")
             for f in glob.glob(f"{path.removeprefix('file:')}/{part}/*.parquet")]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files}
    assert files and codecs == {"ZSTD"}
