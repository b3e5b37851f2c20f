"""Physical-plan properties the design relies on (checked on the executed plans)."""

import io
from contextlib import redirect_stdout

from pressroom.operators import listing as LS
from pressroom.operators.articles import ARTICLE_COLUMNS
from pressroom.operators.extract import extract_raw
from pressroom.plans import fixtures as FX
from pressroom.session import scratch_path
from pressroom.sources.pages import assign_source, read_pages
from pressroom.sources.profiles import profiles_df

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _table(spark):
    path = scratch_path(spark, "t-plan-articles")
    FX.articles_view(spark, SF_SMALL).select(*ARTICLE_COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def test_listing_pushes_source_filter_and_uses_top_k(spark):
    t = _table(spark)
    page = _plan(LS.page_articles(t, page=2, limit=20, source="src0", search="the"))
    assert "EqualTo(source,src0)" in page            # reaches the Parquet scan
    assert "TakeOrderedAndProject" in page           # no global sort for a page
    assert "Exchange rangepartitioning" not in page
    count = _plan(LS.count_articles(t, source="src0", search="the"))
    assert "partial_count" in count                  # map-side combine
    assert "ReadSchema: struct<id:bigint,title:string,perex:string,source:string>" in count  # pruned


def test_text_and_listing_stay_in_the_jvm(spark):
    plan = _plan(FX.articles_view(spark, SF_SMALL))
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert python_node not in plan
    t = _table(spark)
    listing = _plan(LS.page_articles(t, page=1, limit=20, source="src0", search="the"))
    assert "EvalPython" not in listing and "MapInPandas" not in listing


def test_extraction_is_one_narrow_python_stage(spark):
    pages = assign_source(read_pages(spark, f"{SF_SMALL}/pages.parquet"), profiles_df(spark))
    plan = _plan(extract_raw(pages))
    import re
    assert len(re.findall(r"^\(\d+\) MapInPandas", plan, re.M)) == 1
    # the profile registry is broadcast; only it (folded by host) is shuffled, pages never
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert len(re.findall(r"Arguments: hashpartitioning\(", plan)) <= 1
