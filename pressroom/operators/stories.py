"""Stories: articles of any source that tell the same thing within some hours, as clusters kept from batch to batch.

Signature of an article: the ``SIGNATURE`` least MD5 digests of the ``SHINGLE``-word runs of its whole normalised title
(a shorter title is one run).  Two articles link if they share a digest and lie at most ``hours`` apart; a story is what
links connect, named by its smallest article id.

Interval join in time buckets: buckets are as wide as the interval, so articles that share a digest and a bucket always
link (one row a digest and bucket with its first and last time stands for all, aggregated map-side: a digest shared by
a third of all articles is no hot group), the next bucket links if its first time is near enough to this one's last, and
farther buckets never do.

State: rows (digest, bucket, first, last, article), labels (article, story) and merges (story, into story), written per
batch with a commit row last.  A batch reads only the buckets around its own times.  Batches may come in any order, also
late or repeated; the stories are those of one run over everything.  A replayed batch number writes its folder again.

An article without a time or words is a story of its own; one without an id is left out; rows that repeat an id are one
article told at several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.functions.text import normalize_title
from pressroom.operators.components import connected_components
from pressroom.session import checkpoint_dir

SHINGLE, SIGNATURE, HOURS = 5, 8, 12
CELL = "digest string, bucket long, first long, last long, node long"


def signature(title: str | Column) -> Column:
    """The least digests of the title's word runs, ascending; empty for a title without words."""
    def of(words: Column) -> Column:
        n = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
        runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.md5(F.array_join(F.slice(words, i, SHINGLE), " ")))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
            F.slice(F.sort_array(F.array_distinct(runs)), 1, SIGNATURE))

    words = F.filter(F.split(normalize_title(title), " "), lambda w: w != "")
    return F.transform(F.array(words), of)[0]  # bound once: inside the lambda the words would be cut for every run


def _seconds(t: str) -> Column:
    return F.unix_seconds(F.col(t).cast("timestamp"))


def _cells(rows: DataFrame) -> DataFrame:
    """One row a digest and bucket."""
    return rows.groupBy("digest", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                F.min("node").alias("node"))


def _read(spark: SparkSession, path: str, what: str, ddl: str, before: int | None = None) -> DataFrame:
    """Rows of a part of the state, of committed batches (before a batch) only."""
    committed = _committed(spark, path, before)
    if not committed:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(f"{ddl}, batch long").parquet(f"{path}/{what}").where(F.col("batch").isin(committed)).drop(
        "batch")


def _committed(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    rows = spark.read.schema("batch long").parquet(f"{path}/commits").distinct().collect()  # one short row a batch
    return sorted(r.batch for r in rows if before is None or r.batch < before)


def read_stories(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """id, story of every article so far."""
    checkpoint_dir(spark)
    labels = _read(spark, path, "labels", "id long, story long", before)
    merges = _read(spark, path, "merges", "story long, into long", before)
    if merges.isEmpty():
        return labels.groupBy("id").agg(F.min("story").alias("story"))
    roots = connected_components(merges, "story", "into").withColumnRenamed("node", "story")
    return (labels.join(roots, "story", "left").select("id", F.coalesce("root", "story").alias("story"))
            .groupBy("id").agg(F.min("story").alias("story")))


def update_stories(articles: DataFrame, path: str, batch: int, hours: int = HOURS, id_col: str = "id",
                   title_col: str = "title", time_col: str = "scraped_at") -> None:
    """Add a batch of articles to the stories in the folder ``path``."""
    spark = articles.sparkSession
    checkpoint_dir(spark)
    width = hours * 3600
    rows = articles.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("node"), _seconds(time_col).alias("at"), signature(F.col(title_col)).alias("sig"))
    rows = rows.checkpoint()
    parts = rows.where("at IS NOT NULL").select("node", "at", F.explode("sig").alias("digest")).select(
        "digest", F.floor(F.col("at") / width).alias("bucket"), F.col("at").alias("first"), F.col("at").alias("last"), "node")
    new = _cells(parts).checkpoint()
    span = new.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
    old_labels = read_stories(spark, path, batch).checkpoint()
    old = _read(spark, path, "cells", CELL, batch)
    old = old.where(F.col("bucket").between((span.lo or 0) - 1, (span.hi or 0) + 1))
    near = _cells(old.join(new.select("digest").distinct(), "digest", "left_semi"))
    # state rows speak for their story
    near = (near.join(old_labels.withColumnRenamed("id", "node"), "node")
            .select("digest", "bucket", "first", "last", F.col("story").alias("node")))
    both = new.unionByName(near)
    cells = _cells(both).checkpoint()

    star = parts.select("digest", "bucket", F.col("node").alias("a")).join(
        cells.select("digest", "bucket", F.col("node").alias("b")), ["digest", "bucket"]).select("a", "b")
    joined = near.select("digest", "bucket", F.col("node").alias("a")).join(
        cells.select("digest", "bucket", F.col("node").alias("b")), ["digest", "bucket"]).select("a", "b")
    following = cells.select("digest", (F.col("bucket") - 1).alias("bucket"), F.col("first").alias("then"),
                             F.col("node").alias("b"))
    chain = (cells.select("digest", "bucket", "last", F.col("node").alias("a")).join(following, ["digest", "bucket"])
             .where(F.col("then") - F.col("last") <= width).select("a", "b"))
    known = rows.select(F.col("node").alias("a")).join(old_labels.select(F.col("id").alias("a"), F.col("story").alias("b")),
                                                       "a")  # articles told again
    edges = star.unionByName(joined).unionByName(chain).unionByName(known).where("a <> b").distinct()
    roots = connected_components(edges).checkpoint()

    labels = (rows.select("node").distinct().join(roots, "node", "left")
              .select(F.col("node").alias("id"), F.coalesce("root", "node").alias("story")))
    merges = (roots.where("node <> root").join(old_labels.select(F.col("story").alias("node")).distinct(), "node", "left_semi")
              .select(F.col("node").alias("story"), F.col("root").alias("into")))
    for what, df in (("cells", new), ("labels", labels), ("merges", merges)):
        df.write.mode("overwrite").parquet(f"{path}/{what}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/of={batch}")


def story_coverage(stories: DataFrame, articles: DataFrame, id_col: str = "id", time_col: str = "scraped_at") -> DataFrame:
    """Per story and source: n_articles, first_at, last_at, place (order in which sources took the story up),
    lag_seconds behind the first, and after_source, the source that took it up last before (as of ``first_at``).  The as-of
    step runs over one row a source."""
    told = articles.select(F.col(id_col).alias("id"), "source", F.col(time_col).alias("at")).join(stories, "id")
    per = told.groupBy("story", "source").agg(F.count("*").alias("n_articles"), F.min("at").alias("first_at"),
                                              F.max("at").alias("last_at"))
    w = Window.partitionBy("story").orderBy(F.asc_nulls_last("first_at"), "source")
    start = F.min("first_at").over(Window.partitionBy("story"))
    return per.select("story", "source", "n_articles", "first_at", "last_at", F.row_number().over(w).alias("place"),
                      (_secs(F.col("first_at")) - _secs(start)).alias("lag_seconds"),
                      F.lag("source").over(w).alias("after_source"))


def _secs(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))
