"""Article table storage: change log (S4), latest-version read (S3), compaction and
snapshots (S6).

Layout under a table folder::

    log/batch_id=N/       rows written by batch N (inserted or changed), ARTICLE_SCHEMA
    base/upto=N/          a compacted copy: the latest version of every id up to batch N
    commits/batch_id=N/   one row, written last: what batch N is (stream, epoch, max_id)
    bases/upto=N/         one row, written last: base N is whole

A batch is its rows first and its commit row last; readers know only committed batches
and bases, so what a run that died half way has left is never read.  The table allots
batch numbers: a stream's epoch keeps the number of its commit row, a replay rewrites
that batch (an empty replay empties it), and every new epoch of any stream gets the next
number.  One writer at a time is assumed.  Readers take the newest base plus the log
batches after it and keep the highest ``batch_id`` per id.  Only the changed rows of a
batch are ever written; untouched rows are never rewritten until a compaction.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.operators.articles import ARTICLE_COLUMNS, ARTICLE_SCHEMA
from pressroom.session import shuffles_freed

LOG = "log"
BASE = "base"
COMMITS = "commits"
BASES = "bases"
COMMIT_SCHEMA = "stream string, epoch long, max_id long, batch_id long"
CODEC = "zstd"
FEW_IDS = 1_000_000                # ids that may be broadcast


def _p(path: str, *parts) -> str:
    return "/".join([path.rstrip("/")] + [str(p) for p in parts])


def _records(spark: SparkSession, path: str, schema: str) -> list:
    """The commit rows under ``path`` (one per batch or base); [] when there are none."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException:
        return []


def commits(spark: SparkSession, path: str) -> list:
    return sorted(_records(spark, _p(path, COMMITS), COMMIT_SCHEMA), key=lambda r: r["batch_id"])


def bases(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(r["upto"]) for r in _records(spark, _p(path, BASES), "n long, upto long"))


def write_changes(changes: DataFrame, path: str, batch_id: int, max_id: int | None = None,
                  stream: str | None = None, epoch: int | None = None) -> None:
    """Write one batch (its changed + new rows) as ``batch_id``, then its commit row.

    ``max_id`` (the table's highest id after the batch) is kept there, so the next batch
    needs no scan of the id column to number its inserts."""
    spark = changes.sparkSession
    with shuffles_freed(spark):
        (changes.select(*ARTICLE_COLUMNS)
         .sortWithinPartitions("source", "scraped_at")   # row-group stats prune source filters
         .write.mode("overwrite").option("compression", CODEC).parquet(_p(path, LOG, f"batch_id={int(batch_id)}")))
    row = (stream, epoch, None if max_id is None else int(max_id))
    (spark.createDataFrame([row], "stream string, epoch long, max_id long").coalesce(1)
     .write.mode("overwrite").parquet(_p(path, COMMITS, f"batch_id={int(batch_id)}")))


def max_id(spark: SparkSession, path: str, as_of_batch: int | None = None) -> int | None:
    """Highest id after ``as_of_batch`` (default: the last batch) from the commit rows;
    None when the last batch recorded none (callers then scan)."""
    known = [r for r in commits(spark, path) if as_of_batch is None or r["batch_id"] <= as_of_batch]
    return known[-1]["max_id"] if known else 0


def batches(spark: SparkSession, path: str) -> list[int]:
    return [int(r["batch_id"]) for r in commits(spark, path)]


def next_batch_id(spark: SparkSession, path: str, stream: str | None = None, epoch: int | None = None) -> int:
    """The number of a new batch, or of the committed one of the same stream and epoch."""
    known = commits(spark, path)
    for r in known:
        if stream is not None and (r["stream"], r["epoch"]) == (stream, epoch):
            return int(r["batch_id"])
    return int(known[-1]["batch_id"]) + 1 if known else 1


def read_articles(spark: SparkSession, path: str, as_of_batch: int | None = None,
                  source: str | None = None) -> DataFrame:
    """S3: the article table = latest version of each id, optionally as it was after
    batch ``as_of_batch`` (a replayed batch reads the state before itself).  ``source``
    keeps one source's articles; an id never changes its source, so the filter goes to
    the scan, before the versions are compared."""
    done = [b for b in bases(spark, path) if as_of_batch is None or b <= as_of_batch]
    upto = done[-1] if done else 0
    later = [b for b in batches(spark, path) if b > upto and (as_of_batch is None or b <= as_of_batch)]
    own = (lambda df: df if source is None else df.filter(F.col("source") == source))
    if later:
        log_schema = T.StructType(ARTICLE_SCHEMA.fields + [T.StructField("batch_id", T.LongType())])
        log = own(spark.read.schema(log_schema).option("basePath", _p(path, LOG))
                  .parquet(*[_p(path, LOG, f"batch_id={b}") for b in later]))
        # the newest version is chosen on keys alone; texts are joined to it once
        newest = log.groupBy("id").agg(F.max("batch_id").alias("batch_id")) if len(later) > 1 else None
        delta = log if newest is None else log.join(newest, ["id", "batch_id"], "left_semi")
    elif not done:
        delta = spark.createDataFrame([], ARTICLE_SCHEMA)
    if not done:
        return delta.select(*ARTICLE_COLUMNS)
    base = own(spark.read.schema(ARTICLE_SCHEMA).parquet(_p(path, BASE, f"upto={upto}"))).select(*ARTICLE_COLUMNS)
    return _not_in(base, delta.select("id")).unionByName(delta.select(*ARTICLE_COLUMNS)) if later else base


def _not_in(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``base`` whose id is not among ``ids``.  Texts stay where they are if one
    side of it is counted as few: the ids that go, or those that are kept."""
    if ids.count() <= FEW_IDS:
        return base.join(F.broadcast(ids), "id", "left_anti")
    kept = base.select("id").join(ids, "id", "left_anti").withColumnRenamed("id", "kept")
    if kept.limit(FEW_IDS + 1).count() <= FEW_IDS:
        return base.join(F.broadcast(kept), F.col("id").eqNullSafe(F.col("kept")), "left_semi")
    return base.join(ids, "id", "left_anti")


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold the log into a new base (one row per id); returns its ``upto``.  Old
    bases and log partitions are left in place (readers ignore them)."""
    b = batches(spark, path)
    if not b:
        return None
    upto = b[-1]
    target = _p(path, BASE, f"upto={upto}")
    if upto not in bases(spark, path):
        # range-partitioned by (source, scraped_at): each file holds a narrow slice, so
        # the listing's source filter and newest-first order skip most row groups
        with shuffles_freed(spark):
            (read_articles(spark, path).repartitionByRange("source", "scraped_at")
             .sortWithinPartitions("source", "scraped_at").write.mode("overwrite").option("compression", CODEC)
             .parquet(target))
        (spark.createDataFrame([(1,)], "n long").coalesce(1).write.mode("overwrite")
         .parquet(_p(path, BASES, f"upto={upto}")))
    return upto


def snapshot_table(spark: SparkSession, path: str, when: _dt.datetime | None = None,
                   source: DataFrame | None = None) -> str | None:
    """Timestamp-suffixed copy ``{path}_backup_{yyyyMMdd_HHmmss}`` of the current
    table; None when the table does not exist.  Never overwrites."""
    if source is None:
        if not batches(spark, path) and not bases(spark, path):
            return None
        source = read_articles(spark, path)
    when = when or _dt.datetime.utcnow()
    target = f"{path.rstrip('/')}_backup_{when.strftime('%Y%m%d_%H%M%S')}"
    source.write.mode("errorifexists").parquet(target)
    return target
