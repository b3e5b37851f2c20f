"""Listing query: newest-first, filtered, searched, paged.

One shared predicate feeds two plans: a filtered ``count`` (partial aggregation on
every partition, one row shuffled per partition) and a top-k page
(``TakeOrderedAndProject`` keeps offset+limit rows per partition; nothing is sorted
globally).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.operators.articles import listing_predicate

# --- fixed values ----------------------------------------------------------------------
DEFAULT_PAGE = 1
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
# Envelope key order of the JSON listing.
ENVELOPE_KEYS = ["articles", "page", "limit", "total", "total_pages"]
# Article key order inside the JSON listing.
ARTICLE_JSON_KEYS = ["title", "perex", "source", "url", "title_hash", "scraped_at", "updated_at", "id"]
JSON_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
JSON_FRACTION_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"   # where the fraction is not zero
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ListingParams:
    page: int = DEFAULT_PAGE
    limit: int = DEFAULT_LIMIT
    source: str | None = None
    search: str | None = None

    def __post_init__(self):
        # L4 bounds, enforced on the driver before any plan is built.
        if not isinstance(self.page, int) or self.page < 1:
            raise ValueError(f"page must be >= 1, got {self.page!r}")
        if not isinstance(self.limit, int) or not (1 <= self.limit <= MAX_LIMIT):
            raise ValueError(f"limit must be in 1..{MAX_LIMIT}, got {self.limit!r}")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def filtered(df: DataFrame, source=None, search=None) -> DataFrame:
    p = listing_predicate(source, search)
    return df if p is None else df.filter(p)


def newest_first(df: DataFrame) -> DataFrame:
    """L1: scraped_at descending (NULLs last, as SQLite orders them); id descending
    breaks ties (our choice, the reference leaves ties unspecified)."""
    return df.orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id").desc_nulls_last())


def page_articles(df: DataFrame, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT,
                  source=None, search=None) -> DataFrame:
    """L2: the page slice of the filtered, newest-first listing."""
    prm = ListingParams(page, limit, source, search)
    ordered = newest_first(filtered(df, prm.source, prm.search))
    if prm.offset:
        ordered = ordered.offset(prm.offset)
    return ordered.limit(prm.limit)


def count_articles(df: DataFrame, source=None, search=None) -> DataFrame:
    """A1: filtered count(id) as a one-row DataFrame."""
    return filtered(df, source, search).agg(F.count("id").alias("total"))


def page_meta_values(total: int, page: int, limit: int) -> dict:
    """L3: paging metadata from the filtered count."""
    prm = ListingParams(page, limit)
    total_pages = (total + prm.limit - 1) // prm.limit
    return {"page": prm.page, "limit": prm.limit, "total": total, "total_pages": total_pages,
            "has_previous": prm.page > 1, "has_next": prm.page < total_pages}


def page_meta(total_df: DataFrame, page: int, limit: int) -> DataFrame:
    """L3 as a one-row DataFrame over the A1 count."""
    prm = ListingParams(page, limit)
    total = F.col("total")
    total_pages = F.floor((total + F.lit(prm.limit - 1)) / F.lit(prm.limit)).cast("bigint")
    return total_df.select(
        F.lit(prm.page).cast("bigint").alias("page"),
        F.lit(prm.limit).cast("bigint").alias("limit"),
        total.cast("bigint").alias("total"),
        total_pages.alias("total_pages"),
        (F.lit(prm.page) > 1).alias("has_previous"),
        (F.lit(prm.page) < total_pages).alias("has_next"),
    )


def available_sources(df: DataFrame) -> DataFrame:
    """A3: distinct sources (sorted; the reference returns them unsorted)."""
    return df.select("source").distinct().orderBy("source")


#: Up to this many rows a page is a top-k of offset + limit; deeper pages are found by counts.
TOP_K = 10_000


def deep_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """The rows [offset, offset + limit) of the newest-first order without carrying all
    rows before them: counts per hour (one row per hour, summed up on the driver) tell
    which hours hold the slice, and only those are ordered."""
    hour = F.date_trunc("hour", F.col("scraped_at"))
    counts = {r["h"]: r["n"] for r in df.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, seen, hours = None, 0, []
    for h in sorted((h for h in counts if h is not None), reverse=True) + [h for h in counts if h is None]:
        if seen + counts[h] > offset and seen < offset + limit:
            first = seen if first is None else first
            hours.append(h)
        seen += counts[h]
    if not hours:
        return df.limit(0)
    known = [h for h in hours if h is not None]
    keep = F.lit(False)
    if known:
        lo, hi = (F.lit(h).cast(df.schema["scraped_at"].dataType) for h in (min(known), max(known)))
        keep = (F.col("scraped_at") >= lo) & (F.col("scraped_at") < hi + F.expr("INTERVAL 1 HOUR"))
    if None in hours:
        keep = keep | F.col("scraped_at").isNull()
    return newest_first(df.filter(keep)).offset(offset - first).limit(limit)


def article_listing(df: DataFrame, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT,
                    source=None, search=None) -> DataFrame:
    """L4: page rows with the listing metadata attached to every row.

    Two actions over one shared predicate, as the reference runs them: the filtered
    count (one scalar back to the driver), then the top-k page with the metadata
    attached as literals.  A page past the end returns no rows, no error."""
    prm = ListingParams(page, limit, source, search)
    total = count_articles(df, prm.source, prm.search).first()["total"]
    meta = page_meta_values(int(total), prm.page, prm.limit)
    if prm.offset >= total:
        rows = df.limit(0)
    elif prm.offset + prm.limit <= TOP_K:
        rows = page_articles(df, prm.page, prm.limit, prm.source, prm.search)
    else:
        rows = deep_page(filtered(df, prm.source, prm.search), prm.offset, prm.limit)
    return rows.select("*", *[F.lit(v).cast("bigint" if not isinstance(v, bool) else "boolean").alias(k)
                              for k, v in meta.items()])


def page_envelope(df: DataFrame, page: int = DEFAULT_PAGE, limit: int = DEFAULT_LIMIT,
                  source=None, search=None) -> DataFrame:
    """The JSON listing ``{"articles": [...], "page", "limit", "total",
    "total_pages"}`` as a one-row ``json`` column.  The article array holds at most
    ``limit`` (<= 100) rows, so collecting it into one row is bounded by construction."""
    prm = ListingParams(page, limit, source, search)
    rows = page_articles(df, prm.page, prm.limit, prm.source, prm.search)
    whole = lambda c: F.date_trunc("second", c).cast("timestamp_ntz") == F.col(c)
    ts = lambda c: F.when(whole(c), F.date_format(c, JSON_TIMESTAMP_FORMAT)).when(
        ~whole(c), F.date_format(c, JSON_FRACTION_FORMAT))
    art = F.struct(*[ts(k).alias(k) if k in ("scraped_at", "updated_at") else F.col(k) for k in ARTICLE_JSON_KEYS])
    ordered = rows.select(F.struct(F.col("scraped_at").alias("s"), F.col("id").alias("i")).alias("_k"), art.alias("a"))
    arr = (ordered.agg(F.sort_array(F.collect_list(F.struct("_k", "a")), asc=False).alias("_arr"))
           .select(F.transform("_arr", lambda x: x["a"]).alias("articles")))
    total = int(count_articles(df, prm.source, prm.search).first()["total"])
    meta = page_meta_values(total, prm.page, prm.limit)
    env = arr.select(F.struct(
        F.coalesce(F.col("articles"), F.array()).alias("articles"),
        F.lit(prm.page).alias("page"),
        F.lit(prm.limit).alias("limit"),
        F.lit(total).cast("bigint").alias("total"),
        F.lit(meta["total_pages"]).cast("bigint").alias("total_pages"),
    ).alias("env"))
    return env.select(F.to_json("env", {"ignoreNullFields": "false"}).alias("json"))
