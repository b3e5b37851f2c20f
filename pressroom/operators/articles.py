"""Article records: schema, validity gate (F1), keying projection (F6), predicates
(F2, F4, F5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.functions.search import search_predicate
from pressroom.functions.text import clean_text, normalize_url, title_hash, truncate_perex

# The persisted article table (one row per article id).
ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("perex", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("title_hash", T.StringType(), True),
    T.StructField("scraped_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])
ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]

# Candidate record as it leaves extraction.
CANDIDATE_COLUMNS = ["title", "perex", "source", "url"]

# --- fixed values ----------------------------------------------------------------------
MIN_TITLE_CHARS = 10
MAX_PEREX_CHARS = 500
# ---------------------------------------------------------------------------------------


def validate_articles(df: DataFrame, base_url="base_url", keep=()) -> tuple[DataFrame, DataFrame]:
    """F1 ``create_article``: clean title and perex, normalise the url against the
    source's base url, keep rows whose title has >= 10 characters and whose url starts
    with 'http'.  Returns (valid, rejects); rejects carry a ``reason``.

    Runs as one projection + two filters over the same columns (no shuffle)."""
    base = F.col(base_url) if isinstance(base_url, str) and base_url in df.columns else (
        F.lit(base_url) if isinstance(base_url, str) else base_url)
    cleaned = df.select(
        *[F.col(k) for k in keep],
        clean_text("title").alias("title"),
        clean_text("perex").alias("perex"),
        F.col("source"),
        normalize_url(F.col("url"), base).alias("url"),
    )
    reason = (F.when(F.length("title") < MIN_TITLE_CHARS, F.lit("short_title"))
              .when(~F.col("url").startswith("http"), F.lit("bad_url")))
    valid = (cleaned.filter(reason.isNull())
             .withColumn("perex", truncate_perex("perex", MAX_PEREX_CHARS)))
    rejects = cleaned.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return valid, rejects


def to_articles(df: DataFrame) -> DataFrame:
    """candidate -> keyed article base (adds the title hash)."""
    return df.withColumn("title_hash", title_hash("title"))


def filter_source(df: DataFrame, source: str | None) -> DataFrame:
    """equality filter on source, skipped when falsy.  Pushed to the Parquet scan."""
    return df.filter(F.col("source") == source) if source else df


def listing_predicate(source: str | None = None, search: str | None = None) -> Column | None:
    """the optional conjunction of F2 and F3, built once and shared by the row
    query and the count query."""
    preds = []
    if source:
        preds.append(F.col("source") == F.lit(source))
    sp = search_predicate(search)
    if sp is not None:
        preds.append(sp)
    if not preds:
        return None
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def missing_key_predicate(col: str = "title_hash") -> Column:
    """key missing = NULL or empty string."""
    return F.col(col).isNull() | (F.col(col) == "")
