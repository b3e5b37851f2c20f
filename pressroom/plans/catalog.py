"""Registered queries: one Spark plan per SURVEY §2 row (or group of rows), each
reading whole driver tables, with the DuckDB oracle SQL that must give the same
rows.  ``__spark_entry__`` exposes these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions import text as TX
from pressroom.operators import articles as AR
from pressroom.operators import listing as LS
from pressroom.plans import fixtures as FX
from pressroom.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------------------- listing
FLAGSHIP = dict(page=1, limit=20, source="src0", search="the")


def _listing_sql(page: int, limit: int, source, search) -> str:
    where = O.listing_where(source, search)
    off = (page - 1) * limit
    return f"""
WITH a AS ({O.ARTICLES}),
f AS (SELECT * FROM a {where}),
m AS (SELECT count(id) AS total FROM f)
SELECT p.id, p.title, p.perex, p.source, p.url, p.title_hash, p.scraped_at, p.updated_at,
       CAST({page} AS BIGINT) AS page, CAST({limit} AS BIGINT) AS "limit", CAST(m.total AS BIGINT) AS total,
       CAST((m.total + {limit} - 1) // {limit} AS BIGINT) AS total_pages,
       {page} > 1 AS has_previous, {page} < (m.total + {limit} - 1) // {limit} AS has_next
FROM (SELECT * FROM f ORDER BY scraped_at DESC NULLS LAST, id DESC LIMIT {limit} OFFSET {off}) p, m
"""


def _listing(spark, sf_dir, page, limit, source, search):
    arts = AR_select(FX.articles_view(spark, sf_dir))
    return LS.article_listing(arts, page=page, limit=limit, source=source, search=search)


def AR_select(df: DataFrame) -> DataFrame:
    return df.select(*AR.ARTICLE_COLUMNS)


@register("listing_flagship", _listing_sql(**FLAGSHIP))
def q_listing_flagship(spark, sf_dir):
    """L4 (F2+F3+F4+A1+L1-L3): page 1 of src0 articles containing 'the'."""
    return _listing(spark, sf_dir, **FLAGSHIP)


@register("listing_all_page3", _listing_sql(3, 7, None, None))
def q_listing_all_page3(spark, sf_dir):
    """L1/L2: page 3 of 7 over the whole table, no filter (ties on scraped_at)."""
    return _listing(spark, sf_dir, 3, 7, None, None)


@register("listing_past_end", _listing_sql(400, 100, "src3", None))
def q_listing_past_end(spark, sf_dir):
    """L3: a page past the end yields no rows and no error."""
    return _listing(spark, sf_dir, 400, 100, "src3", None)


@register("listing_search_wildcard", _listing_sql(2, 15, None, "E_ _"))
def q_listing_search_wildcard(spark, sf_dir):
    """typed '_' is a wildcard, ASCII case folds."""
    return _listing(spark, sf_dir, 2, 15, None, "E_ _")


SEARCH_TERMS = ["the", "THE", "b", "%", "_", "a_b", "e%s", "\\", "é", "É", "ÉTÉ", "qu'", "zz", "de la"]


@register("search_counts", " UNION ALL ".join(
    f"SELECT {O.sq(t)} AS term, count(id) AS total FROM ({O.ARTICLES}) a WHERE {O.search_pred(t)}"
    for t in SEARCH_TERMS))
def q_search_counts(spark, sf_dir):
    """Filtered counts for a fixed set of search terms (wildcards, backslash,
    accents that must not fold), all in one scan: one count_if per term, then
    unpivoted to (term, total)."""
    arts = FX.articles_view(spark, sf_dir)
    from pressroom.functions.search import search_predicate
    aggs = [F.count_if(search_predicate(t)).alias(f"t{i}") for i, t in enumerate(SEARCH_TERMS)]
    wide = arts.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("total"))
                      for i, t in enumerate(SEARCH_TERMS)])
    return wide.select(F.inline(pairs))


@register("count_by_source_search", f"""
SELECT source, count(id) AS total FROM ({O.ARTICLES}) a
WHERE {O.search_pred('the')} GROUP BY source""")
def q_count_by_source_search(spark, sf_dir):
    """A1 per source: searched count grouped by source (partial aggregation)."""
    arts = FX.articles_view(spark, sf_dir)
    return LS.filtered(arts, search="the").groupBy("source").agg(F.count("id").alias("total"))


@register("available_sources", f"SELECT DISTINCT source FROM ({O.ARTICLES}) a")
def q_available_sources(spark, sf_dir):
    """A3: distinct sources."""
    return LS.available_sources(FX.articles_view(spark, sf_dir))


# --------------------------------------------------------------------- scalar functions
@register("articles_view", f"SELECT id, title, perex, source, url, title_hash, scraped_at, updated_at FROM ({O.ARTICLES}) a")
def q_articles_view(spark, sf_dir):
    """T1, T3, T4, T5, F6, S3 shape: documents keyed as articles (whole texts)."""
    return AR_select(FX.articles_view(spark, sf_dir))


# A message per text, so that every class of T9 occurs, first matches included.
_MESSAGE_SQL = ("(text || CASE doc_id % 4 WHEN 0 THEN ' NS_ERROR_UNKNOWN_HOST timeout' "
                "WHEN 1 THEN ' Timeout 60000ms, connection' WHEN 2 THEN ' net::Connection refused' ELSE '' END)")


@register("text_labels", f"""
SELECT doc_id, {O.initcap('source')} AS source_label,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 97 AS BIGINT)), '%d.%m.%Y %H:%M') AS scraped_label,
       CASE WHEN contains(lower({_MESSAGE_SQL}), 'ns_error_unknown_host') THEN 'dns'
            WHEN contains(lower({_MESSAGE_SQL}), 'timeout') THEN 'timeout'
            WHEN contains(lower({_MESSAGE_SQL}), 'connection') THEN 'connection' ELSE 'other' END AS error_class,
       {O.normalize_title('text')} AS norm_text,
       length({O.clean_text('text')}) AS clean_len
FROM documents""")
def q_text_labels(spark, sf_dir):
    """T6, T7, T9, T3 and T1 over whole document texts."""
    d = FX.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        TX.source_label("source").alias("source_label"),
        TX.scraped_label(FX._scraped_at(F.col("doc_id"))).alias("scraped_label"),
        TX.classify_error(F.concat("text", F.when(F.col("doc_id") % 4 == 0, " NS_ERROR_UNKNOWN_HOST timeout")
                                   .when(F.col("doc_id") % 4 == 1, " Timeout 60000ms, connection")
                                   .when(F.col("doc_id") % 4 == 2, " net::Connection refused")
                                   .otherwise(""))).alias("error_class"),
        TX.normalize_title("text").alias("norm_text"),
        F.length(TX.clean_text("text")).alias("clean_len"),
    )


_URL_FORMS = """
  SELECT page_id, 0 AS form, url AS raw FROM pages
  UNION ALL SELECT page_id, 1, regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) FROM pages
  UNION ALL SELECT page_id, 2, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1), '^/+', '') FROM pages
  UNION ALL SELECT page_id, 3, '' FROM pages
  UNION ALL SELECT page_id, 4, '//' || regexp_extract(url, '^[a-z]+://(.*)$', 1) FROM pages
  UNION ALL SELECT page_id, 5, '#' || CAST(page_id AS VARCHAR) FROM pages
"""


@register("normalize_url", f"""
SELECT page_id, form, raw, {O.normalize_url('raw', "'https://base.example.cz/'")} AS url
FROM ({_URL_FORMS}) f""")
def q_normalize_url(spark, sf_dir):
    """T2 over every page URL in six shapes: absolute, '/path', 'path', '', '//host',
    '#frag' (the last two keep the reference's base+text behaviour)."""
    p = FX.table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)$", 1)
    forms = [
        p.select("page_id", F.lit(0).alias("form"), F.col("url").alias("raw")),
        p.select("page_id", F.lit(1).alias("form"), path.alias("raw")),
        p.select("page_id", F.lit(2).alias("form"), F.regexp_replace(path, "^/+", "").alias("raw")),
        p.select("page_id", F.lit(3).alias("form"), F.lit("").alias("raw")),
        p.select("page_id", F.lit(4).alias("form"),
                 F.concat(F.lit("//"), F.regexp_extract("url", r"^[a-z]+://(.*)$", 1)).alias("raw")),
        p.select("page_id", F.lit(5).alias("form"), F.concat(F.lit("#"), F.col("page_id").cast("string")).alias("raw")),
    ]
    u = forms[0]
    for f in forms[1:]:
        u = u.unionByName(f)
    return u.select("page_id", F.col("form").cast("int").alias("form"), "raw",
                    TX.normalize_url(F.col("raw"), "https://base.example.cz/").alias("url"))


# Candidate records with every validity outcome: every line of every text as a title,
# and url forms absolute / relative / empty / non-http.
_CAND_SQL = """
  SELECT doc_id, line, source, 'https://' || source || '.example.com' AS base_url, ls[line] AS title, ls[line] AS perex,
         CASE (doc_id + line) % 4 WHEN 0 THEN '/a/' || CAST(doc_id AS VARCHAR)
                         WHEN 1 THEN 'https://cdn.example.org/' || CAST(doc_id AS VARCHAR)
                         WHEN 2 THEN '' ELSE 'ftp://x/' || CAST(doc_id AS VARCHAR) END AS url
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS line
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents) t0) t1"""


def _candidates(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("at", "title"))
    d = d.withColumn("line", F.col("at").cast("bigint") + 1)
    m4 = (F.col("doc_id") + F.col("line")) % 4
    url = (F.when(m4 == 0, F.concat(F.lit("/a/"), F.col("doc_id").cast("string")))
           .when(m4 == 1, F.concat(F.lit("https://cdn.example.org/"), F.col("doc_id").cast("string")))
           .when(m4 == 2, F.lit(""))
           .otherwise(F.concat(F.lit("ftp://x/"), F.col("doc_id").cast("string"))))
    return d.select(
        "doc_id", "line", "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("base_url"),
        "title", F.col("title").alias("perex"), url.alias("url"))


@register("validate_articles", f"""
WITH c AS (SELECT doc_id, line, source, {O.clean_text('title')} AS title, {O.clean_text('perex')} AS perex,
                  {O.normalize_url('url', 'base_url')} AS url FROM ({_CAND_SQL}) c0)
SELECT doc_id, line, title, substr(perex, 1, 500) AS perex, source, url, {O.title_hash('title')} AS title_hash
FROM c WHERE length(title) >= 10 AND starts_with(url, 'http')""")
def q_validate_articles(spark, sf_dir):
    """F1 + F6 (+T1, T2, T5): candidate gate and keying over every document."""
    valid, _ = AR.validate_articles(_candidates(spark, sf_dir), base_url="base_url", keep=["doc_id", "line"])
    return AR.to_articles(valid).select("doc_id", "line", "title", "perex", "source", "url", "title_hash")


@register("reject_reasons", f"""
WITH c AS (SELECT {O.clean_text('title')} AS title, {O.normalize_url('url', 'base_url')} AS url FROM ({_CAND_SQL}) c0)
SELECT CASE WHEN length(title) < 10 THEN 'short_title' ELSE 'bad_url' END AS reason, count(*) AS n
FROM c WHERE NOT (length(title) >= 10 AND starts_with(url, 'http')) GROUP BY 1""")
def q_reject_reasons(spark, sf_dir):
    """F1 complement: rejected candidates counted by reason."""
    _, rejects = AR.validate_articles(_candidates(spark, sf_dir), base_url="base_url")
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Articles with what a JSON listing must not lose: NULL fields and fractions of a second.
_JSON_TS = ("CASE WHEN date_part('microsecond', {c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
            "ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")
_JSON_ARTICLES = f"""SELECT id, title, CASE WHEN id % 3 = 0 THEN NULL ELSE perex END AS perex, source, url, title_hash,
  scraped_at + to_microseconds(CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE id % 1000 END AS BIGINT)) AS scraped_at,
  CASE WHEN id % 5 = 0 THEN NULL ELSE updated_at END AS updated_at FROM ({O.ARTICLES}) a0"""


@register("listing_json", f"""
WITH a AS ({_JSON_ARTICLES}), f AS (SELECT * FROM a WHERE source = 'src1'),
p AS (SELECT * FROM f ORDER BY scraped_at DESC NULLS LAST, id DESC LIMIT 5 OFFSET 5)
SELECT to_json(struct_pack(
  articles := coalesce((SELECT list(struct_pack(title := title, perex := perex, source := source, url := url,
        title_hash := title_hash, scraped_at := {_JSON_TS.format(c='scraped_at')},
        updated_at := {_JSON_TS.format(c='updated_at')}, id := id)
        ORDER BY scraped_at DESC NULLS LAST, id DESC) FROM p), []),
  page := 2, "limit" := 5, total := (SELECT count(id) FROM f),
  total_pages := CAST(((SELECT count(id) FROM f) + 4) // 5 AS BIGINT)))::VARCHAR AS json""")
def q_listing_json(spark, sf_dir):
    """JSON envelope of page 2 (limit 5) of source src1, NULL fields kept."""
    i = F.col("id")
    a = AR_select(FX.articles_view(spark, sf_dir))
    micros = F.when(i % 4 == 0, 0).otherwise(i % 1000)
    a = (a.withColumn("perex", F.when(i % 3 != 0, F.col("perex")))
         .withColumn("scraped_at", F.col("scraped_at") + F.make_dt_interval(
             F.lit(0), F.lit(0), F.lit(0), (micros / 1000000).cast("decimal(18,6)")))
         .withColumn("updated_at", F.when(i % 5 != 0, F.col("updated_at"))))
    return LS.page_envelope(a, page=2, limit=5, source="src1")


# ------------------------------------------------------------------------------ upsert
import datetime as _dt  # noqa: E402

from pressroom.operators import upsert as UP  # noqa: E402

BATCH_TIME = _dt.datetime(2024, 2, 1, 0, 0, 0)
_BT = "TIMESTAMP '2024-02-01 00:00:00'"

_TITLE_DUPS_SQL = f"""
  SELECT id AS seq, title, perex, lang AS source, url, title_hash FROM ({O.ARTICLES}) a"""
_URL_DUPS_SQL = f"""
  SELECT seq, title, perex, source, url, {O.title_hash('title')} AS title_hash FROM (
    SELECT id AS seq, title || ' ' || CAST(id AS VARCHAR) AS title, perex, source,
           'https://x.example.com/a/' || CAST(id % 97 AS VARCHAR) AS url FROM ({O.ARTICLES}) a) b0"""


@register("upsert_title_dups", f"""
WITH b AS ({_TITLE_DUPS_SQL}),
g AS (SELECT source, title_hash, min(seq) AS first_seq, arg_min(title, seq) AS title,
             arg_max(url, seq) AS url, arg_max(perex, seq) AS perex FROM b GROUP BY source, title_hash)
SELECT CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url, title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at FROM g""")
def q_upsert_title_dups(spark, sf_dir):
    """Batch in which only the (title_hash, source) rule fires, into an
    empty table: per group the first item's id/title, the last item's url/perex."""
    return UP.upsert_articles(UP.empty_articles(spark), FX.batch_title_dups(spark, sf_dir), BATCH_TIME).table


@register("upsert_url_dups", f"""
WITH b AS ({_URL_DUPS_SQL}),
g AS (SELECT url, min(seq) AS first_seq, arg_min(source, seq) AS source, arg_max(title, seq) AS title,
             arg_max(perex, seq) AS perex, arg_max(title_hash, seq) AS title_hash FROM b GROUP BY url)
SELECT CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url, title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at FROM g""")
def q_upsert_url_dups(spark, sf_dir):
    """Batch in which only the url rule fires (97 urls shared across
    sources): per url the first item's id/source, the last item's title/perex/hash."""
    return UP.upsert_articles(UP.empty_articles(spark), FX.batch_url_dups(spark, sf_dir), BATCH_TIME).table


@register("ingest_summary_title_dups", f"""
WITH b AS ({_TITLE_DUPS_SQL}), r AS (SELECT source, title_hash, count(*) AS n FROM b GROUP BY 1, 2)
SELECT source, CAST(count(*) AS BIGINT) AS new, CAST(sum(n) - count(*) AS BIGINT) AS updated,
       CAST(0 AS BIGINT) AS by_url, CAST(sum(n) - count(*) AS BIGINT) AS by_title
FROM r GROUP BY ROLLUP (source)""")
def q_ingest_summary_title_dups(spark, sf_dir):
    """J6 + A2: outcome tags of the title-rule batch rolled up per source + total."""
    res = UP.upsert_articles(UP.empty_articles(spark), FX.batch_title_dups(spark, sf_dir), BATCH_TIME)
    return UP.ingest_summary(res.outcomes)


@register("ingest_summary_url_dups", f"""
WITH b AS ({_URL_DUPS_SQL}),
f AS (SELECT seq, source, seq = min(seq) OVER (PARTITION BY url) AS first FROM b)
SELECT source, CAST(count_if(first) AS BIGINT) AS new, CAST(count_if(NOT first) AS BIGINT) AS updated,
       CAST(count_if(NOT first) AS BIGINT) AS by_url, CAST(0 AS BIGINT) AS by_title
FROM f GROUP BY ROLLUP (source)""")
def q_ingest_summary_url_dups(spark, sf_dir):
    """J6 + A2 for the url-rule batch (updates counted under the item's source)."""
    res = UP.upsert_articles(UP.empty_articles(spark), FX.batch_url_dups(spark, sf_dir), BATCH_TIME)
    return UP.ingest_summary(res.outcomes)


# The contested batch never reaches the table's rows (its urls use another host, its
# sources are languages), so its result is the table plus a sequential fold of the
# items among themselves.  DuckDB runs that fold as a recursive CTE, one item per
# step, over list-valued state (rows in insert order, so the lowest key is the
# lowest list index): url, hash, source, and the seqs that last set title / url /
# perex.  Exact, and O(items x rows) - fine at sf0.01, a reference check only.
_MIXED_SQL = f"""
WITH RECURSIVE
a AS ({O.ARTICLES}),
b AS (SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS rn, id AS seq, title, perex, lang AS source,
             'https://x.example.com/a/' || CAST(id % 97 AS VARCHAR) AS url, title_hash AS h FROM a),
f(step, u, hh, s, ts, us, ps) AS (
  SELECT CAST(0 AS BIGINT), []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::BIGINT[], []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT step + 1,
    CASE WHEN m1 IS NOT NULL THEN u
         WHEN m2 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m2 THEN iu ELSE u[i] END)
         ELSE list_append(u, iu) END,
    CASE WHEN m1 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m1 THEN ih ELSE hh[i] END)
         WHEN m2 IS NOT NULL THEN hh ELSE list_append(hh, ih) END,
    CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL THEN s ELSE list_append(s, isrc) END,
    CASE WHEN m1 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m1 THEN iq ELSE ts[i] END)
         WHEN m2 IS NOT NULL THEN ts ELSE list_append(ts, iq) END,
    CASE WHEN m1 IS NOT NULL THEN us
         WHEN m2 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m2 THEN iq ELSE us[i] END)
         ELSE list_append(us, iq) END,
    CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL
         THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = coalesce(m1, m2) THEN iq ELSE ps[i] END)
         ELSE list_append(ps, iq) END
  FROM (SELECT f.*, b.seq AS iq, b.url AS iu, b.h AS ih, b.source AS isrc,
               list_min(list_filter(range(1, len(f.u) + 1), lambda i: f.u[i] = b.url)) AS m1,
               list_min(list_filter(range(1, len(f.u) + 1), lambda i: f.hh[i] = b.h AND f.s[i] = b.source)) AS m2
        FROM f JOIN b ON b.rn = f.step + 1) x
),
last AS (SELECT * FROM f ORDER BY step DESC LIMIT 1),
rows_ AS (SELECT i, u[i] AS url, hh[i] AS title_hash, s[i] AS source, ts[i] AS tseq, ps[i] AS pseq
          FROM last, range(1, len(last.u) + 1) r(i))
SELECT id, title, perex, source, url, title_hash, scraped_at, updated_at FROM a
UNION ALL
SELECT CAST((SELECT max(id) FROM a) + r.i AS BIGINT) AS id, bt.title, bp.perex, r.source, r.url, r.title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at
FROM rows_ r JOIN b bt ON bt.seq = r.tseq JOIN b bp ON bp.seq = r.pseq"""


@register("upsert_mixed", _MIXED_SQL)
def q_upsert_mixed(spark, sf_dir):
    """J1-J6 contested: both rules fire and interact (urls shared through doc_id % 97
    across languages, 80-char title duplicates); applied on top of the articles_view
    table.  Oracle: the sequential fold as a recursive CTE (above); also checked
    against a brute-force fold in tests/test_upsert.py."""
    existing = AR_select(FX.articles_view(spark, sf_dir))
    return UP.upsert_articles(existing, FX.batch_mixed(spark, sf_dir), BATCH_TIME).table


_REKEY_SQL = f"""
  SELECT id AS seq, title, perex, source,
         'https://' || source || '.example.com/a/' || CAST((id * 7) % (SELECT count(*) FROM documents) AS VARCHAR) AS url,
         title_hash FROM ({O.ARTICLES}) a"""


def _rekeyed(spark, sf_dir):
    a = FX.articles_view(spark, sf_dir)
    n = FX.table(spark, sf_dir, "documents").count()  # one scalar, taken once
    return a.select(
        F.col("id").alias("seq"), "title", "perex", "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"),
                 ((F.col("id") * 7) % F.lit(n)).cast("string")).alias("url"),
        "title_hash")


@register("match_by_url", f"""
WITH e AS ({O.ARTICLES}), i AS ({_REKEY_SQL}), m AS (SELECT url, min(id) AS id FROM e GROUP BY url)
SELECT i.seq, i.url, m.id FROM i LEFT JOIN m USING (url)""")
def q_match_by_url(spark, sf_dir):
    """J1 lookup against the table before the batch (lowest id per url)."""
    e = AR_select(FX.articles_view(spark, sf_dir))
    return UP.match_by_url(e, _rekeyed(spark, sf_dir)).select("seq", "url", "id")


@register("match_by_title", f"""
WITH e AS ({O.ARTICLES}), i AS (SELECT id AS seq, title_hash, lang AS source FROM ({O.ARTICLES}) a0),
m AS (SELECT title_hash, source, min(id) AS id FROM (SELECT id, title_hash, lang AS source FROM e) e2 GROUP BY 1, 2)
SELECT i.seq, i.title_hash, i.source, m.id FROM i LEFT JOIN m USING (title_hash, source)""")
def q_match_by_title(spark, sf_dir):
    """J2 lookup against the table before the batch (lowest id per (hash, source))."""
    a = FX.articles_view(spark, sf_dir)
    e = a.select("id", "title_hash", F.col("lang").alias("source"))
    i = a.select(F.col("id").alias("seq"), "title_hash", F.col("lang").alias("source"))
    return UP.match_by_title(e, i).select("seq", "title_hash", "source", "id")


@register("new_articles", f"""
WITH e AS ({O.ARTICLES}), i AS (SELECT seq, url, source, md5(title_hash || 'x') AS title_hash FROM ({_REKEY_SQL}) r)
SELECT seq, url FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.url = i.url)
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.title_hash = i.title_hash AND e.source = i.source)""")
def q_new_articles(spark, sf_dir):
    """J4 fast-path predicate: items missing the table on both keys."""
    e = AR_select(FX.articles_view(spark, sf_dir))
    i = _rekeyed(spark, sf_dir).withColumn("title_hash", F.md5(F.concat("title_hash", F.lit("x"))))
    return UP.new_articles(e, i).select("seq", "url")


# -------------------------------------------------------------------------- extraction
from pressroom.operators.extract import extract_articles  # noqa: E402
from pressroom.plans import ingest as IN  # noqa: E402
from pressroom.sources.pages import assign_source, read_pages  # noqa: E402
from pressroom.sources.profiles import NEWS_PROFILES as _NEWS  # noqa: E402
from pressroom.sources.profiles import profiles_df  # noqa: E402


def _pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir.rstrip('/')}/pages.parquet")


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"


def _decode(x):
    return f"replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"


_PAGES_DIRECT_SQL = f"""
  SELECT page_id, 0 AS pos, source, url, title,
         substr(CASE WHEN length(perex0) >= 20 THEN perex0 ELSE '' END, 1, 500) AS perex,
         {O.title_hash('title')} AS title_hash
  FROM (SELECT page_id, url, source, {O.clean_text('h1')} AS title, {O.clean_text('ptext')} AS perex0
        FROM (SELECT page_id, url, {_HOST_SQL} AS source,
                     {_decode("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
                     {_decode("regexp_replace(regexp_extract(art, '(?s)</h1>.*?(<p>.*)$', 1), '<[^>]*>', '', 'g')")} AS ptext
              FROM (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages) p0) p1) p2
  WHERE length(title) >= 10"""


@register("host_labels", f"SELECT page_id, {O.initcap(_HOST_SQL)} AS label FROM pages")
def q_host_labels(spark, sf_dir):
    """T6 over page hosts, as S8 names unknown sources: each run of letters in title case."""
    from pressroom.sources.pages import page_host
    return _pages(spark, sf_dir).select("page_id", TX.source_label(page_host("url")).alias("label"))


_NEWS_BY_PAGE = ", ".join(f"({i}, {O.sq(p.name)}, {O.sq(p.base_url)}, {O.sq(p.host)})" for i, p in enumerate(_NEWS))


@register("pages_by_registry", f"""
WITH r(i, source, base_url, host) AS (VALUES {_NEWS_BY_PAGE}, (12, NULL, NULL, 'unknown.example.org'))
SELECT page_id, source, base_url, CAST(i AS INTEGER) AS source_rank FROM pages JOIN r ON r.i = page_id % 13
WHERE source IS NOT NULL""")
def q_pages_by_registry(spark, sf_dir):
    """Every stored page moved to a news host, with ``www.`` or without, or to an
    unknown one; one row per page of a registered host, none for the others."""
    hosts = F.array(*[F.lit(p.host) for p in _NEWS], F.lit("unknown.example.org"))
    www = F.when((F.col("page_id") / 13).cast("bigint") % 2 == 0, "WWW.").otherwise("")
    at = F.get(hosts, (F.col("page_id") % 13).cast("int"))
    pages = _pages(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), www, at, F.lit("/x?y=1")))
    return assign_source(pages, profiles_df(spark)).select("page_id", "source", "base_url", "source_rank")


@register("pages_direct", _PAGES_DIRECT_SQL)
def q_pages_direct(spark, sf_dir):
    """S1 + S7 + E1-E6 + F1 + F6: every stored page through the extraction stage
    (fallback profile: container article, title h1, perex p, url = page url; source =
    host).  Exercises the unclosed-<p> nesting rule and entity decoding."""
    assigned = assign_source(_pages(spark, sf_dir), profiles_df(spark), fallback="page")
    arts, _, _ = extract_articles(assigned)
    return arts.select("page_id", "pos", "source", "url", "title", "perex", "title_hash")


_LISTING_DOCS_SQL = f"""
  SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY source, doc_id // 1000) AS page_id,
         CAST(row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS INTEGER) AS pos
  FROM documents"""

_LISTING_EXTRACT_SQL = f"""
  SELECT page_id, pos, source, url, title,
         substr(CASE WHEN length(perex0) >= 20 THEN perex0 ELSE '' END, 1, 500) AS perex,
         {O.title_hash('title')} AS title_hash
  FROM (SELECT page_id, pos, source, 'https://' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS url,
               {O.clean_text('text')} AS title, {O.clean_text('text')} AS perex0
        FROM ({_LISTING_DOCS_SQL}) d) c
  WHERE length(title) >= 10"""


@register("listing_extract", _LISTING_EXTRACT_SQL)
def q_listing_extract(spark, sf_dir):
    """E1-E5 + T2: front pages rebuilt from whole documents (h2 > a links, escaped
    text) parsed back into candidates."""
    arts, _, _ = extract_articles(FX.listing_pages(spark, sf_dir))
    return arts.select("page_id", "pos", "source", "url", "title", "perex", "title_hash")


@register("listing_rejects", f"""
  SELECT source, count(*) AS n FROM ({_LISTING_DOCS_SQL}) d
  WHERE length({O.clean_text('text')}) < 10 GROUP BY source""")
def q_listing_rejects(spark, sf_dir):
    """E3 misses: containers whose title stays under 10 characters, per source (they
    never reach the gate; counted from the stage output)."""
    from pressroom.operators.extract import extract_raw
    pages = FX.listing_pages(spark, sf_dir)
    raw = extract_raw(pages).select("page_id", "pos")
    # the positions on each page: documents per page
    sizes = (FX.table(spark, sf_dir, "documents")
             .groupBy("source", (F.col("doc_id") / FX.LISTING_DOCS_PER_PAGE).cast("bigint").alias("blk"))
             .agg(F.min("doc_id").alias("page_id"), F.count(F.lit(1)).cast("int").alias("n")))
    there = sizes.select("page_id", "source", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return (there.join(raw, ["page_id", "pos"], "left_anti")
            .groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@register("listing_capped", f"""
WITH d AS (SELECT source, pos, {O.clean_text('text')} AS title FROM ({_LISTING_DOCS_SQL}) d0)
SELECT source, CAST(count_if(pos < 30 AND length(title) >= 10) AS BIGINT) AS found,
       CAST(count_if(pos >= 30) AS BIGINT) AS cut FROM d GROUP BY source""")
def q_listing_capped(spark, sf_dir):
    """The run option that stops at the profile's candidate cap (30 a page, before
    validation); what it cuts is reported, a reject row per candidate."""
    arts, rejects, _ = extract_articles(FX.listing_pages(spark, sf_dir), use_cap=True)
    both = arts.select("source", F.lit(1).alias("f"), F.lit(0).alias("c")).unionByName(
        rejects.filter(F.col("reason") == "over_cap").select("source", F.lit(0).alias("f"), F.lit(1).alias("c")))
    return both.groupBy("source").agg(F.sum("f").alias("found"), F.sum("c").alias("cut"))


_LISTING_ITEMS_SQL = f"""
  SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, title, perex, source, url, title_hash
  FROM ({_LISTING_EXTRACT_SQL}) x"""


@register("ingest_listing", f"""
WITH b AS ({_LISTING_ITEMS_SQL}),
g AS (SELECT source, title_hash, min(seq) AS first_seq, arg_min(title, seq) AS title,
             arg_max(url, seq) AS url, arg_max(perex, seq) AS perex FROM b GROUP BY source, title_hash)
SELECT CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url, title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at FROM g""")
def q_ingest_listing(spark, sf_dir):
    """An all-sources run over the rebuilt front pages into an empty table
    (one plan, source as a column; arrival = page, position)."""
    res = IN.ingest(FX.listing_pages(spark, sf_dir), UP.empty_articles(spark), BATCH_TIME)
    return res.upsert.table


@register("ingest_listing_summary", f"""
WITH b AS ({_LISTING_ITEMS_SQL}), r AS (SELECT source, title_hash, count(*) AS n FROM b GROUP BY 1, 2)
SELECT source, CAST(count(*) AS BIGINT) AS new, CAST(sum(n) - count(*) AS BIGINT) AS updated,
       CAST(0 AS BIGINT) AS by_url, CAST(sum(n) - count(*) AS BIGINT) AS by_title
FROM r GROUP BY ROLLUP (source)""")
def q_ingest_listing_summary(spark, sf_dir):
    """S8 + A2: per-source new / updated counts of the run, with a total row."""
    res = IN.ingest(FX.listing_pages(spark, sf_dir), UP.empty_articles(spark), BATCH_TIME)
    return res.summary


@register("ingest_one_source", f"""
WITH b AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, * FROM ({_LISTING_EXTRACT_SQL}) x WHERE source = 'src3'),
g AS (SELECT source, title_hash, min(seq) AS first_seq, arg_min(title, seq) AS title,
             arg_max(url, seq) AS url, arg_max(perex, seq) AS perex FROM b GROUP BY source, title_hash)
SELECT CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url, title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at FROM g""")
def q_ingest_one_source(spark, sf_dir):
    """Single-source run (source checked against the known sources, pages
    filtered before extraction)."""
    pages = FX.listing_pages(spark, sf_dir)
    res = IN.ingest(pages, UP.empty_articles(spark), BATCH_TIME, source="src3", valid_sources=pages.select("source"))
    return res.upsert.table


@register("ingest_pages_summary", f"""
WITH b AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, * FROM ({_PAGES_DIRECT_SQL}) x),
r AS (SELECT source, title_hash, count(*) AS n FROM b GROUP BY 1, 2)
SELECT source, CAST(count(*) AS BIGINT) AS new, CAST(sum(n) - count(*) AS BIGINT) AS updated,
       CAST(0 AS BIGINT) AS by_url, CAST(sum(n) - count(*) AS BIGINT) AS by_title
FROM r GROUP BY ROLLUP (source)""")
def q_ingest_pages_summary(spark, sf_dir):
    """S8 over the stored pages (fallback profile, source = host): per-host summary."""
    res = IN.ingest(_pages(spark, sf_dir), UP.empty_articles(spark), BATCH_TIME, fallback="page")
    return res.summary


# ------------------------------------------------------------- schema evolution, store
from pressroom.operators import schema as SC  # noqa: E402
from pressroom.session import scratch_path, written  # noqa: E402
from pressroom.sources import store as ST  # noqa: E402

_FILL = "(title IS NOT NULL AND title <> '')"


@register("migrate_v2_missing", f"""
SELECT id, title, perex, source, url,
       CASE WHEN {_FILL} THEN {O.title_hash('title')} END AS title_hash, scraped_at,
       CASE WHEN {_FILL} THEN {_BT} END AS updated_at
FROM ({O.ARTICLES}) a""")
def q_migrate_v2_missing(spark, sf_dir):
    """M1 + M2 + M3 on a pre-migration table lacking title_hash and updated_at."""
    df, _ = SC.migrate_v2(FX.legacy_articles(spark, sf_dir, "missing"), BATCH_TIME)
    return df.select(*AR.ARTICLE_COLUMNS)


_BLANK_SQL = f"""
  SELECT id, CASE WHEN id % 30 = 0 THEN '' ELSE title END AS title, perex, source, url,
         CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE title_hash END AS title_hash,
         scraped_at, updated_at FROM ({O.ARTICLES}) a"""
_MISSING = "(title_hash IS NULL OR title_hash = '')"


@register("migrate_v2_blank", f"""
SELECT id, title, perex, source, url,
       CASE WHEN {_MISSING} AND {_FILL} THEN {O.title_hash('title')} ELSE title_hash END AS title_hash,
       scraped_at,
       CASE WHEN {_MISSING} AND {_FILL} THEN {_BT} ELSE updated_at END AS updated_at
FROM ({_BLANK_SQL}) l""")
def q_migrate_v2_blank(spark, sf_dir):
    """M2 + F5: NULL and '' hashes are filled where the title is non-empty; empty
    titles stay unfilled; existing columns are not re-added (M1 returns False)."""
    df, _ = SC.migrate_v2(FX.legacy_articles(spark, sf_dir, "blank"), BATCH_TIME)
    return df.select(*AR.ARTICLE_COLUMNS)


@register("migrate_store_blank", f"""
SELECT id, title, perex, source, url,
       CASE WHEN {_MISSING} AND {_FILL} THEN {O.title_hash('title')} ELSE title_hash END AS title_hash,
       scraped_at,
       CASE WHEN {_MISSING} AND {_FILL} THEN {_BT} ELSE updated_at END AS updated_at
FROM ({_BLANK_SQL}) l""")
def q_migrate_store_blank(spark, sf_dir):
    """M3 on stored tables: the legacy table is written, migrated into a change-log
    store as its first version, and a second migration writes nothing."""
    legacy = scratch_path(spark, "legacy")
    FX.legacy_articles(spark, sf_dir, "blank").write.parquet(legacy)
    store = scratch_path(spark, "articles")
    SC.migrate_store(spark, store, BATCH_TIME, legacy_path=legacy)
    if SC.migrate_store(spark, store, BATCH_TIME) is not None:
        raise RuntimeError("second migration wrote a new version")
    return ST.read_articles(spark, store)


@register("missing_keys", f"""
SELECT source, count(*) AS n, count_if({_FILL}) AS fillable FROM ({_BLANK_SQL}) l WHERE {_MISSING} GROUP BY source""")
def q_missing_keys(spark, sf_dir):
    """rows with a missing key per source, and how many the backfill can fill."""
    df = FX.legacy_articles(spark, sf_dir, "blank")
    fillable = F.col("title").isNotNull() & (F.col("title") != "")
    return (df.filter(AR.missing_key_predicate("title_hash")).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(fillable).alias("fillable")))


def _v2_items(spark, sf_dir):
    """Second scrape of every article: same title and source, a new mobile url and a
    new perex; arrival = doc id."""
    a = FX.articles_view(spark, sf_dir)
    return a.select(F.col("id").alias("seq"), "title", F.concat(F.lit("v2 "), F.col("perex")).alias("perex"), "source",
                    F.concat(F.lit("https://m."), F.col("source"), F.lit(".example.com/a/"), F.col("id").cast("string")).alias("url"),
                    "title_hash")


_CHANGELOG_SQL = f"""
WITH a AS ({O.ARTICLES}),
i AS (SELECT id AS seq, 'v2 ' || perex AS perex, source, title_hash,
             'https://m.' || source || '.example.com/a/' || CAST(id AS VARCHAR) AS url FROM a),
g AS (SELECT source, title_hash, min(id) AS target FROM a GROUP BY 1, 2),
w AS (SELECT g.target, arg_max(i.url, i.seq) AS url, arg_max(i.perex, i.seq) AS perex
      FROM i JOIN g USING (source, title_hash) GROUP BY g.target)
SELECT a.id, a.title, coalesce(w.perex, a.perex) AS perex, a.source, coalesce(w.url, a.url) AS url, a.title_hash,
       a.scraped_at, CASE WHEN w.target IS NULL THEN a.updated_at ELSE {_BT} END AS updated_at
FROM a LEFT JOIN w ON a.id = w.target"""


def _changelog_two_batches(spark, sf_dir, compact_between: bool):
    path = scratch_path(spark, "articles")
    ST.write_changes(AR_select(FX.articles_view(spark, sf_dir)), path, ST.next_batch_id(spark, path))
    if compact_between:
        ST.compact(spark, path)
    res = UP.upsert_articles(ST.read_articles(spark, path), _v2_items(spark, sf_dir), BATCH_TIME, lean=True)
    bid = ST.next_batch_id(spark, path)
    changes = written(res.changes, "changes", lots=4)  # the batch is committed twice: derive its rows once
    ST.write_changes(changes, path, bid)
    ST.write_changes(changes, path, bid)  # replaying a batch changes nothing
    return ST.read_articles(spark, path)


@register("changelog_latest", _CHANGELOG_SQL)
def q_changelog_latest(spark, sf_dir):
    """S4 + S3 + J2: batch 1 writes the table, batch 2 re-scrapes every article under
    a new url (title rule: the lowest id of each (hash, source) takes the last url and
    perex); batch 2 is committed twice (idempotent); the read keeps the newest
    version per id."""
    return _changelog_two_batches(spark, sf_dir, compact_between=False)


@register("changelog_compacted", _CHANGELOG_SQL)
def q_changelog_compacted(spark, sf_dir):
    """Compaction between the batches: base + later log partitions read the same."""
    return _changelog_two_batches(spark, sf_dir, compact_between=True)


@register("snapshot_roundtrip", f"SELECT id, title, perex, source, url, title_hash, scraped_at, updated_at FROM ({O.ARTICLES}) a")
def q_snapshot_roundtrip(spark, sf_dir):
    """A timestamp-suffixed, never-overwriting copy of the table, read back."""
    path = scratch_path(spark, "articles")
    ST.write_changes(AR_select(FX.articles_view(spark, sf_dir)), path, 1)
    target = ST.snapshot_table(spark, path, when=BATCH_TIME)
    return spark.read.parquet(target).select(*AR.ARTICLE_COLUMNS)


# --------------------------------------------------------------------------- run ledger
from pressroom.operators import ledger as LG  # noqa: E402

LEDGER_NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)   # purge cutoff = now - 24 h = 2024-01-30

_RUN_EVENTS_SQL = """
  SELECT user_id AS run_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' END AS status,
         CASE user_id % 3 WHEN 0 THEN 'scrape_all' WHEN 1 THEN 'scrape_source' ELSE 'periodic_scrape' END AS task_type,
         CASE WHEN user_id % 3 = 1 THEN 'src' || CAST(user_id % 7 AS VARCHAR) END AS source,
         CAST(trunc(value) AS BIGINT) AS n,
         event_type || CASE WHEN event_id % 3 = 0 THEN ': Timeout 30000ms' ELSE '' END AS message
  FROM events"""

_RUN_STATE_SQL = f"""
  SELECT run_id, arg_max(status, ts) AS status, arg_max(task_type, ts) AS task_type, min(ts) AS created_at,
         max(ts) FILTER (WHERE status = 'running') AS started_at,
         max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at,
         any_value(source) AS source,
         CAST(arg_max(n, ts) FILTER (WHERE status = 'completed') AS BIGINT) AS articles_scraped,
         arg_max(message, ts) FILTER (WHERE status = 'failed') AS error,
         CASE WHEN count_if(status = 'failed') = 0 THEN NULL
              WHEN contains(lower(arg_max(message, ts) FILTER (WHERE status = 'failed')), 'timeout') THEN 'timeout'
              ELSE 'other' END AS error_class,
         CAST(CASE WHEN count_if(status = 'completed') > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS progress
  FROM ({_RUN_EVENTS_SQL}) e GROUP BY run_id"""


def _state(spark, sf_dir):
    return LG.run_state(FX.run_events_view(spark, sf_dir))


@register("run_state", _RUN_STATE_SQL)
def q_run_state(spark, sf_dir):
    """Lifecycle fold of every run from the append-only event table."""
    return _state(spark, sf_dir)


@register("list_runs", f"SELECT s.*, (SELECT count(*) FROM ({_RUN_STATE_SQL}) c) AS total FROM ({_RUN_STATE_SQL}) s")
def q_list_runs(spark, sf_dir):
    """R2: all runs with the total."""
    return LG.list_runs(_state(spark, sf_dir))


@register("running_runs", f"""
WITH s AS ({_RUN_STATE_SQL}) SELECT *, (SELECT count(*) FROM s WHERE status = 'running') AS total
FROM s WHERE status = 'running'""")
def q_running_runs(spark, sf_dir):
    """Running runs with their count."""
    return LG.running_runs(_state(spark, sf_dir))


@register("runs_by_type", f"SELECT * FROM ({_RUN_STATE_SQL}) s WHERE task_type = 'scrape_source'")
def q_runs_by_type(spark, sf_dir):
    """Runs of one task type."""
    return LG.runs_by_type(_state(spark, sf_dir), "scrape_source")


@register("run_by_id", f"SELECT * FROM ({_RUN_STATE_SQL}) s WHERE run_id = 7")
def q_run_by_id(spark, sf_dir):
    """One run by id."""
    return LG.run_by_id(_state(spark, sf_dir), 7)


@register("purge_runs", f"""
SELECT * FROM ({_RUN_STATE_SQL}) s
WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled') AND completed_at IS NOT NULL
                   AND completed_at < TIMESTAMP '2024-01-30 00:00:00', false)""")
def q_purge_runs(spark, sf_dir):
    """Retention, dropping terminal runs completed more than 24 h before 'now'."""
    return LG.purge_runs(_state(spark, sf_dir), LEDGER_NOW, 24)


def _only_clean(html):
    """A source's own extractor (E9) that gives up on pages with junk marks."""
    import re
    from html import unescape
    if "***" in html:
        raise ValueError("junk marks")
    return [{"title": unescape(t), "perex": "", "url": "/checked"} for t in re.findall("(?s)<title>(.*?)</title>", html)]


_QUARANTINE_SQL = f"""
SELECT page_id, source, CASE WHEN error IS NULL THEN 'article' ELSE 'quarantined' END AS outcome,
       CASE WHEN error IS NULL THEN 0 ELSE -1 END AS pos, coalesce(error, title) AS detail
FROM (SELECT page_id, {_HOST_SQL} AS source, {O.clean_text(_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
             CASE WHEN page_id % 3 = 1 THEN 'KeyError: ''gone'''
                  WHEN page_id % 3 = 2 AND contains(html, '***') THEN 'ValueError: junk marks' END AS error
      FROM pages WHERE page_id % 3 > 0) x
WHERE error IS NOT NULL OR length(title) >= 10
UNION ALL
SELECT page_id, source, 'article' AS outcome, pos, title AS detail FROM ({_PAGES_DIRECT_SQL}) y WHERE page_id % 3 = 0"""


@register("pages_quarantine", _QUARANTINE_SQL)
def q_pages_quarantine(spark, sf_dir):
    """E6 + E9 over every stored page: a third go through the fallback profile, a third through a profile that no longer
    exists, a third through an extractor that fails on some pages.  What fails is a row with its error; the rest of the run
    is as it would be without it."""
    from pressroom.sources.profiles import registry
    known = registry()
    pages = assign_source(_pages(spark, sf_dir), profiles_df(spark), fallback="page")
    third = F.col("page_id") % 3
    pages = pages.withColumn("profile", F.when(third == 1, "gone").when(third == 2, "checked").otherwise(F.col("profile")))
    arts, _, failed = extract_articles(pages, known | {"checked": known["page"]}, {"checked": _only_clean})
    return (arts.select("page_id", "source", F.lit("article").alias("outcome"), "pos", F.col("title").alias("detail"))
            .unionByName(failed.select("page_id", "source", F.lit("quarantined").alias("outcome"), "pos",
                                       F.col("error").alias("detail"))))


# ---------------------------------------------------------------------------- streaming
_PAGES_TABLE_SQL = f"""
WITH b AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, * FROM ({_PAGES_DIRECT_SQL}) x),
g AS (SELECT source, title_hash, min(seq) AS first_seq, arg_min(title, seq) AS title,
             arg_max(url, seq) AS url, arg_max(perex, seq) AS perex FROM b GROUP BY source, title_hash)
SELECT CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url, title_hash,
       {_BT} AS scraped_at, {_BT} AS updated_at FROM g"""


@register("ingest_pages", _PAGES_TABLE_SQL)
def q_ingest_pages(spark, sf_dir):
    """S8 over every stored page into an empty table, one batch."""
    return IN.ingest(_pages(spark, sf_dir), UP.empty_articles(spark), BATCH_TIME, fallback="page").upsert.table


@register("stream_ingest_pages", _PAGES_TABLE_SQL)
def q_stream_ingest_pages(spark, sf_dir):
    """S2 + W2 + W4: the pages arrive as two drops; after each a run-now stream under the
    same checkpoint takes what is new, against the table left by the one before.  The
    final table equals the one-batch ingest."""
    from pressroom.streaming.ingest_stream import stream_ingest
    drops = scratch_path(spark, "page-drops")
    table = scratch_path(spark, "articles")
    ckpt = scratch_path(spark, "stream-ckpt")
    pages = _pages(spark, sf_dir)
    mid = int(pages.agg(F.percentile_approx("page_id", 0.5)).first()[0])
    for half in (F.col("page_id") <= mid, F.col("page_id") > mid):
        pages.filter(half).write.mode("append").parquet(drops)
        q = stream_ingest(spark, drops, table, ckpt, trigger="now", clock=lambda: BATCH_TIME, fallback="page")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return ST.read_articles(spark, table)


_TWO_STREAMS_SQL = f"""
WITH a AS ({O.ARTICLES}), nx AS (SELECT max(id) AS m FROM a),
b AS (SELECT row_number() OVER (ORDER BY page_id, pos) AS seq, * FROM ({_PAGES_DIRECT_SQL}) x),
g AS (SELECT source, title_hash, min(seq) AS first_seq, arg_min(title, seq) AS title,
             arg_max(url, seq) AS url, arg_max(perex, seq) AS perex FROM b GROUP BY source, title_hash)
SELECT id, title, perex, source, url, title_hash, scraped_at, updated_at FROM a
UNION ALL
SELECT (SELECT m FROM nx) + CAST(row_number() OVER (ORDER BY first_seq) AS BIGINT) AS id, title, perex, source, url,
       title_hash, {_BT} AS scraped_at, {_BT} AS updated_at FROM g"""


@register("stream_into_table", _TWO_STREAMS_SQL)
def q_stream_into_table(spark, sf_dir):
    """W2 + W4 on a table that has rows: the articles are migrated into the store, one
    stream ingests the first half of the pages, another (its own checkpoint) the second;
    the table equals its old rows plus one fold over all pages."""
    from pressroom.streaming.ingest_stream import stream_ingest
    table = scratch_path(spark, "articles")
    ST.write_changes(AR_select(FX.articles_view(spark, sf_dir)), table, ST.next_batch_id(spark, table))
    pages = _pages(spark, sf_dir)
    mid = int(pages.agg(F.percentile_approx("page_id", 0.5)).first()[0])
    for half in (F.col("page_id") <= mid, F.col("page_id") > mid):
        drops = scratch_path(spark, "page-drops")
        pages.filter(half).write.parquet(drops)
        q = stream_ingest(spark, drops, table, scratch_path(spark, "stream-ckpt"), trigger="now",
                          clock=lambda: BATCH_TIME, fallback="page")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return ST.read_articles(spark, table)


@register("listing_stored", _listing_sql(3, 20, "src0", None))
def q_listing_stored(spark, sf_dir):
    """L4 over S3: a middle page of one source from the stored table, its filter in the scan."""
    table = scratch_path(spark, "articles")
    ST.write_changes(AR_select(FX.articles_view(spark, sf_dir)), table, ST.next_batch_id(spark, table))
    return LS.article_listing(ST.read_articles(spark, table, source="src0"), page=3, limit=20, source="src0")


# ------------------------------------------------------------- the twelve news profiles
from pressroom.sources.profiles import NEWS_PROFILES  # noqa: E402


def _news_profile_sql() -> str:
    parts = []
    for p in NEWS_PROFILES:
        parts.append(f"""
  SELECT {O.sq(p.name)} AS profile, page_id, pos, source, url, title,
         substr(CASE WHEN length(perex0) >= 20 THEN perex0 ELSE '' END, 1, 500) AS perex,
         {O.title_hash('title')} AS title_hash
  FROM (SELECT page_id, pos, source, 'https://' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS url,
               {O.clean_text('text')} AS title, {O.clean_text('text')} AS perex0
        FROM ({_LISTING_DOCS_SQL}) d) c
  WHERE length(title) >= 10""")
    return " UNION ALL ".join(parts)


@register("news_profiles_extract", _news_profile_sql())
def q_news_profiles_extract(spark, sf_dir):
    """E7 + E1-E5: every rebuilt front page parsed with each of the twelve news-source
    profiles (their full selector lists); each profile's selector chain must
    find the same article records."""
    pages = FX.listing_pages(spark, sf_dir).withColumn("profile", F.array(*[F.lit(p.name) for p in NEWS_PROFILES]))
    arts, _, _ = extract_articles(pages)  # one stage for all twelve, each page parsed once
    return arts.select(F.explode("found_by").alias("profile"), "page_id", "pos", "source", "url", "title", "perex", "title_hash")


# A re-scrape of every article against the table: item i carries the url of article
# 7i mod n (a tenth of them land on another article of the same source: J1 moves its
# title and hash), every other item finds its own row by (hash, source) (J2 moves its
# url), all interleaved in arrival order; the url/hash graph forms long cycles, the
# slow case for component labelling.  The oracle seeds the recursive fold with the
# table's rows in id order (seqs -1 = "as stored").
_RESCRAPE_SQL = f"""
WITH RECURSIVE
a AS ({O.ARTICLES}),
nd AS (SELECT count(*) AS n FROM documents),
b AS (SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS rn, id AS seq, title, 'v2 ' || perex AS perex, source,
             'https://' || source || '.example.com/a/' || CAST((id * 7) % (SELECT n FROM nd) AS VARCHAR) AS url,
             title_hash AS h FROM a),
seed AS (SELECT list(id ORDER BY id) AS k, list(url ORDER BY id) AS u, list(title_hash ORDER BY id) AS hh,
                list(source ORDER BY id) AS s FROM a),
f(step, k, u, hh, s, ts, us, ps) AS (
  SELECT CAST(0 AS BIGINT), k, u, hh, s, list_transform(k, lambda x: CAST(-1 AS BIGINT)),
         list_transform(k, lambda x: CAST(-1 AS BIGINT)), list_transform(k, lambda x: CAST(-1 AS BIGINT)) FROM seed
  UNION ALL
  SELECT step + 1,
    CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL THEN k ELSE list_append(k, CAST(-1 AS BIGINT)) END,
    CASE WHEN m1 IS NOT NULL THEN u
         WHEN m2 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m2 THEN iu ELSE u[i] END)
         ELSE list_append(u, iu) END,
    CASE WHEN m1 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m1 THEN ih ELSE hh[i] END)
         WHEN m2 IS NOT NULL THEN hh ELSE list_append(hh, ih) END,
    CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL THEN s ELSE list_append(s, isrc) END,
    CASE WHEN m1 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m1 THEN iq ELSE ts[i] END)
         WHEN m2 IS NOT NULL THEN ts ELSE list_append(ts, iq) END,
    CASE WHEN m1 IS NOT NULL THEN us
         WHEN m2 IS NOT NULL THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = m2 THEN iq ELSE us[i] END)
         ELSE list_append(us, iq) END,
    CASE WHEN m1 IS NOT NULL OR m2 IS NOT NULL
         THEN list_transform(range(1, len(u) + 1), lambda i: CASE WHEN i = coalesce(m1, m2) THEN iq ELSE ps[i] END)
         ELSE list_append(ps, iq) END
  FROM (SELECT f.*, b.seq AS iq, b.url AS iu, b.h AS ih, b.source AS isrc,
               list_min(list_filter(range(1, len(f.u) + 1), lambda i: f.u[i] = b.url)) AS m1,
               list_min(list_filter(range(1, len(f.u) + 1), lambda i: f.hh[i] = b.h AND f.s[i] = b.source)) AS m2
        FROM f JOIN b ON b.rn = f.step + 1) x
),
last AS (SELECT * FROM f ORDER BY step DESC LIMIT 1),
r AS (SELECT i, k[i] AS k, u[i] AS url, hh[i] AS title_hash, s[i] AS source, ts[i] AS tseq, ps[i] AS pseq
      FROM last, range(1, len(last.u) + 1) q(i)),
nx AS (SELECT count(*) AS n0, max(id) AS m FROM a)
SELECT CASE WHEN r.k >= 0 THEN r.k ELSE CAST((SELECT m FROM nx) + r.i - (SELECT n0 FROM nx) AS BIGINT) END AS id,
       CASE WHEN r.tseq < 0 THEN o.title ELSE bt.title END AS title,
       CASE WHEN r.pseq < 0 THEN o.perex ELSE bp.perex END AS perex,
       r.source, r.url, r.title_hash,
       CASE WHEN r.k >= 0 THEN o.scraped_at ELSE {_BT} END AS scraped_at,
       CASE WHEN r.pseq < 0 THEN o.updated_at ELSE {_BT} END AS updated_at
FROM r LEFT JOIN a o ON o.id = r.k
       LEFT JOIN b bt ON bt.seq = r.tseq LEFT JOIN b bp ON bp.seq = r.pseq"""


@register("upsert_rescrape", _RESCRAPE_SQL)
def q_upsert_rescrape(spark, sf_dir):
    """J1-J6 against a live table: every article re-scraped with a new perex and a
    url taken from another article; J1 and J2 hits on existing rows interleave in
    arrival order and move urls and titles between rows."""
    existing = AR_select(FX.articles_view(spark, sf_dir))
    items = _rekeyed(spark, sf_dir).withColumn("perex", F.concat(F.lit("v2 "), F.col("perex")))
    return UP.upsert_articles(existing, items, BATCH_TIME).table
