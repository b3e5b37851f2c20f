"""Schema evolution with backfill (M1-M3), as one lazy pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.functions.text import batch_timestamp, title_hash
from pressroom.operators.articles import missing_key_predicate

# --- fixed values ----------------------------------------------------------------------
V2_COLUMNS = [("title_hash", T.StringType()), ("updated_at", T.TimestampNTZType())]
# ---------------------------------------------------------------------------------------


def column_exists(df: DataFrame, name: str) -> bool:
    return name in df.columns


def add_column_if_missing(df: DataFrame, name: str, dtype: T.DataType) -> tuple[DataFrame, bool]:
    """M1: add a NULL column of ``dtype``; (df, False) when it is already there."""
    if column_exists(df, name):
        return df, False
    return df.withColumn(name, F.lit(None).cast(dtype)), True


def backfill_title_hash(df: DataFrame, now) -> DataFrame:
    """M2: rows whose title_hash is NULL or '' and whose title is non-empty get the
    hash of their title and updated_at = now; every other row is unchanged."""
    fill = missing_key_predicate("title_hash") & F.col("title").isNotNull() & (F.col("title") != "")
    return (df.withColumn("_fill", fill)
            .withColumn("title_hash", F.when(F.col("_fill"), title_hash("title")).otherwise(F.col("title_hash")))
            .withColumn("updated_at", F.when(F.col("_fill"), batch_timestamp(now)).otherwise(F.col("updated_at")))
            .drop("_fill"))


def migrate_v2(df: DataFrame | None, now) -> tuple[DataFrame | None, bool]:
    """M3: M1(title_hash) + M1(updated_at) + M2.  Idempotent; a missing table is a
    no-op.  ``changed`` reports whether columns were added (a caller writes a new
    table version only then, or when the backfill touched rows)."""
    if df is None:
        return None, False
    changed = False
    for name, dtype in V2_COLUMNS:
        df, added = add_column_if_missing(df, name, dtype)
        changed = changed or added
    return backfill_title_hash(df, now), changed


def migrate_store(spark, path: str, now, legacy_path: str | None = None) -> int | None:
    """M3 against stored tables: bring a table to v2 and write a new version only when
    something changed.

    * ``legacy_path``: a plain pre-migration Parquet table (possibly lacking the v2
      columns); when given and the store is empty it is migrated in one pass and
      committed as the store's first batch.  A missing legacy table is a no-op.
    * Otherwise the store's latest rows that still need a hash are backfilled and only
      those rows are committed, as a new batch.

    Returns the committed batch id, or None when nothing changed."""
    from pyspark.errors import AnalysisException

    from pressroom.operators.articles import ARTICLE_COLUMNS
    from pressroom.sources import store as ST

    bid = ST.next_batch_id(spark, path)
    if legacy_path is not None and bid == 1:
        try:
            legacy = spark.read.parquet(legacy_path)
        except AnalysisException:
            return None  # no table yet: nothing to migrate
        migrated, _ = migrate_v2(legacy, now)
        ST.write_changes(migrated.select(*ARTICLE_COLUMNS), path, bid)
        return bid
    current = ST.read_articles(spark, path)
    fill = missing_key_predicate("title_hash") & F.col("title").isNotNull() & (F.col("title") != "")
    todo = current.filter(fill)
    if todo.limit(1).count() == 0:
        return None
    ST.write_changes(backfill_title_hash(todo, now).select(*ARTICLE_COLUMNS), path, bid)
    return bid
