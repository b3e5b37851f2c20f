"""Page sources (S1, S2) and source assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.session import spread

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored page snapshots (page_id, url, html), spread over the cores when
    the files are fewer than the cores (the parse downstream is CPU-bound)."""
    return spread(spark.read.schema(PAGES_SCHEMA).parquet(path))


def stream_pages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same snapshots as a stream of parquet file drops."""
    r = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def page_host(url_col="url"):
    return F.lower(F.regexp_extract(F.col(url_col), HOST_RE, 1))


def assign_source(pages: DataFrame, profiles: DataFrame, fallback: str | None = None) -> DataFrame:
    """Attach profile, source and base url to each page by URL host, ``www.`` or not.

    ``profiles`` holds one row per host (repeated hosts are folded, lowest rank first), so
    a page matches at most once.  The registry is as small as the number of sources;
    Spark broadcasts it by its measured size.  Pages of unknown hosts are dropped, or
    get the ``fallback`` profile with source = host where one is named."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    p = (profiles.groupBy(bare(F.col("host")).alias("_h"))
         .agg(F.min(F.struct("rank", "profile", "base_url")).alias("_p"))
         .select("_h", F.col("_p.profile").alias("profile"), F.col("_p.base_url").alias("_base"),
                 F.col("_p.rank").alias("source_rank")))
    host = page_host("url")
    j = pages.withColumn("_host", host).join(p, bare(F.col("_host")) == F.col("_h"), "left")
    scheme = F.lower(F.regexp_extract("url", SCHEME_RE, 1))
    out = j.select(
        *[c for c in pages.columns],
        F.coalesce(F.col("profile"), F.lit(fallback)).alias("profile"),
        F.coalesce(F.col("profile"), F.col("_host")).alias("source"),
        F.coalesce(F.col("_base"), F.concat(scheme, F.lit("://"), F.col("_host"))).alias("base_url"),
        F.coalesce(F.col("source_rank"), F.lit(1 << 30)).alias("source_rank"),
    )
    if fallback is None:
        out = out.filter(F.col("profile").isNotNull())
    return out
