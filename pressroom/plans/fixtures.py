"""Derived inputs built by Spark from the driver tables (see FIXTURES.md).

Each builder reads a whole driver table and derives the article-shaped input the
operators need; nothing here is made up or capped.  The DuckDB twins live in
``pressroom.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.text import clean_text, title_hash, truncate_perex
from pressroom.session import spread

# --- fixed values ----------------------------------------------------------------------
EPOCH = "2024-01-01 00:00:00"          # scraped_at origin of articles_view
HOURS_MOD = 97                          # scraped_at = EPOCH + (doc_id % 97) hours
LISTING_DOCS_PER_PAGE = 1000            # listing pages hold docs of one doc_id block
URL_DUP_MOD = 97                        # batch_url_dups: url = x.example.com/a/(doc_id % 97)
# run_events_view: event_type -> run status, user_id % 3 -> task type.
EVENT_STATUS = [("signup", "pending"), ("view", "running"), ("purchase", "completed"),
                ("error", "failed"), ("click", "cancelled")]
TASK_TYPES = ["scrape_all", "scrape_source", "periodic_scrape"]
# ---------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _scraped_at(doc_id) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ '{EPOCH}'") + F.make_dt_interval(
        F.lit(0), (doc_id % HOURS_MOD).cast("int"), F.lit(0), F.lit(0))


def articles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the article table."""
    d = table(spark, sf_dir, "documents")
    title = clean_text("text")
    return (d.select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        truncate_perex(clean_text("text")).alias("perex"),
        F.col("source"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang"),
        _scraped_at(F.col("doc_id")).alias("scraped_at"),
    ).withColumn("title_hash", title_hash("title"))
     .withColumn("updated_at", F.col("scraped_at"))
     .select("id", "title", "perex", "source", "url", "title_hash", "scraped_at", "updated_at", "lang"))


def batch_title_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert batch where only the (title_hash, source) rule fires: source := lang,
    unique URLs, arrival order = doc_id."""
    a = articles_view(spark, sf_dir)
    return a.select(F.col("id").alias("seq"), "title", "perex", F.col("lang").alias("source"), "url", "title_hash")


def batch_url_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert batch where only the URL rule fires: 97 URLs shared across sources,
    titles made unique by appending the doc id."""
    a = articles_view(spark, sf_dir)
    title = F.concat(F.col("title"), F.lit(" "), F.col("id").cast("string"))
    return a.select(
        F.col("id").alias("seq"), title.alias("title"), "perex", "source",
        F.concat(F.lit("https://x.example.com/a/"), (F.col("id") % URL_DUP_MOD).cast("string")).alias("url"),
    ).withColumn("title_hash", title_hash("title"))


def batch_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert batch where both rules fire and contest each other: the URL collides
    across sources through a small modulus and the title rule fires on the copies of a
    text in its language (source := lang)."""
    a = articles_view(spark, sf_dir)
    return a.select(
        F.col("id").alias("seq"), "title", "perex", F.col("lang").alias("source"),
        F.concat(F.lit("https://x.example.com/a/"), (F.col("id") % URL_DUP_MOD).cast("string")).alias("url"),
        "title_hash",
    )


def _escape_html(c) -> F.Column:
    # &, <, > escaped in that order
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front pages rebuilt from ``documents``: one HTML page per (source, block of
    1000 doc ids), one ``<article><h2><a href="/a/ID">TITLE</a></h2><p>TEXT</p></article>``
    per document in doc_id order.  A page holds at most 1000 documents however the
    sources are skewed, so the per-page concat is bounded."""
    d = table(spark, sf_dir, "documents")
    block = F.concat(
        F.lit('<article><h2><a href="/a/'), F.col("doc_id").cast("string"), F.lit('">'),
        _escape_html(F.col("text")), F.lit("</a></h2><p>"),
        _escape_html(F.col("text")), F.lit("</p></article>"))
    pages = (d.select("source", (F.col("doc_id") / LISTING_DOCS_PER_PAGE).cast("bigint").alias("blk"),
                      F.struct("doc_id", block.alias("b")).alias("e"))
             .groupBy("source", "blk")
             .agg(F.array_sort(F.collect_list("e")).alias("es")))
    return pages.select(
        F.col("es")[0]["doc_id"].alias("page_id"),   # first doc id: unique per page
        F.lit("listing").alias("profile"),
        "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("base_url"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/")).alias("url"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform("es", lambda e: e["b"]), ""),
                 F.lit("</body></html>")).alias("html"),
    )


def run_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as run-lifecycle events of the run ledger."""
    e = table(spark, sf_dir, "events")
    status = None
    for et, st in EVENT_STATUS:
        cond = F.col("event_type") == et
        status = F.when(cond, F.lit(st)) if status is None else status.when(cond, F.lit(st))
    ttype = None
    for i, t in enumerate(TASK_TYPES):
        cond = (F.col("user_id") % len(TASK_TYPES)) == i
        ttype = F.when(cond, F.lit(t)) if ttype is None else ttype.when(cond, F.lit(t))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("ts"), F.col("event_id"),
        status.alias("status"), ttype.alias("task_type"),
        F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string"))).alias("source"),
        F.col("value").cast("bigint").alias("n"),
        F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ": Timeout 30000ms").otherwise("")).alias("message"),
    )


def legacy_articles(spark: SparkSession, sf_dir: str, variant: str = "missing") -> DataFrame:
    """Pre-migration article tables: ``missing`` lacks title_hash and updated_at;
    ``blank`` has them, with NULL / '' hashes and some empty titles."""
    a = articles_view(spark, sf_dir).drop("lang")
    if variant == "missing":
        return a.drop("title_hash", "updated_at")
    th = (F.when(F.col("id") % 3 == 0, F.lit(None).cast("string"))
          .when(F.col("id") % 3 == 1, F.lit(""))
          .otherwise(F.col("title_hash")))
    title = F.when(F.col("id") % 30 == 0, F.lit("")).otherwise(F.col("title"))
    return a.withColumn("title_hash", th).withColumn("title", title)
