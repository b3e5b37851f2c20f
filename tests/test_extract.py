"""Extraction stage (E1-E9): hand-written HTML fixtures."""

import pytest

from pressroom.operators.extract import _compile, extract_articles, extract_page
from pressroom.operators.htmltree import Document, SelectorError, compile_selector, select, select_one
from pressroom.sources.profiles import NEWS_PROFILES, Profile, get_profile, register_profile


def prof(containers=("article",), title=("h2 a", "h2"), perex=("p",), url=("h2 a", "a[href]"), cap=80,
         fallback=False):
    return Profile("t", "https://x.cz", cap, tuple(containers), tuple(title), tuple(perex), tuple(url),
                   url_fallback_to_page=fallback).validate()


def run(html, p, page_url=None):
    """(title, perex, raw href) of each candidate; the url is normalised later, in
    the JVM-side validity gate."""
    return [(t, pe, u) for _, t, pe, u, err in extract_page(html, p, _compile(p), page_url) if err is None]


def test_ancestor_outside_container_matches():
    html = '<h2><div class="article"><a href="/a/1">A title that is long</a></div></h2>'
    assert run(html, prof(containers=(".article",))) == [("A title that is long", "", "/a/1")]


def test_short_first_title_moves_to_next_selector_not_next_match():
    html = ('<article><h2>short</h2><h2>second h2 long enough</h2><h3>the h3 title wins here</h3>'
            '<a href="/u">x</a></article>')
    p = prof(title=("h2", "h3"), url=("a[href]",))
    assert run(html, p) == [("the h3 title wins here", "", "/u")]


def test_empty_href_tries_next_selector_and_missing_url_drops():
    # each url selector tests only its first match: a[href] finds the empty link again
    html = ('<article><h2><a href="">Some long title here</a></h2><a class="more" href="/real">r</a></article>'
            '<article><h2>Another long title</h2></article>')
    assert run(html, prof()) == []
    assert run(html, prof(url=("h2 a", "a.more"))) == [("Some long title here", "", "/real")]


def test_nested_containers_emit_twice():
    html = '<article><article><h2><a href="/n">Nested long title</a></h2></article></article>'
    assert len(run(html, prof())) == 2


def test_unclosed_p_nests_and_perex_threshold():
    html = ('<article><h2><a href="/p">Title long enough!</a></h2><p><b>first part <br><p>second part</p>'
            '<p>third</p></article>')
    (t, perex, u), = run(html, prof())
    assert perex == "first part second partthird"
    short = '<article><h2><a href="/p">Title long enough!</a></h2><p>tiny perex</p></article>'
    assert run(short, prof())[0][1] == ""


def test_script_in_heading_and_comments_excluded():
    html = ('<article><h2><a href="/s">Visible<script>var t="x";</script> title text<!-- c --></a></h2>'
            '</article>')
    assert run(html, prof())[0][0] == "Visible title text"


def test_unknown_end_tag_ignored_and_entities_decoded():
    html = '<article></span><h2><a href="/e?a=1&amp;b=2">Tom &amp; Jerry &quot;x&quot;</a></h2></article>'
    assert run(html, prof()) == [('Tom & Jerry "x"', "", "/e?a=1&b=2")]


def test_class_substring_matches_raw_string():
    doc = Document('<div class="cart"></div><div class="party x"></div><div class="a"></div>')
    assert len(select(doc, doc.root, compile_selector('[class*="art"]'))) == 2
    assert len(select(doc, doc.root, compile_selector(".x"))) == 1


def test_containers_selector_major_then_document_order_dedup():
    html = ('<div class="b" id="1"></div><article id="2"></article><div class="b" id="3"></div>'
            '<article class="b" id="4"></article>')
    doc = Document(html)
    p = prof(containers=("article", ".b"))
    seen, out = set(), []
    for m in _compile(p)[0]:
        for e in select(doc, doc.root, m):
            if id(e) not in seen:
                seen.add(id(e))
                out.append(e.get("id"))
    assert out == ["2", "4", "1", "3"]


def test_cap_is_a_run_option_and_counts_failed_candidates():
    from pressroom.operators.extract import OVER_CAP, _compile, extract_page
    html = ('<article><h2>no</h2></article>' * 2
            + '<article><h2><a href="/ok">Accepted long title</a></h2></article>')
    p = prof(cap=2)
    assert len(run(html, p)) == 1
    assert extract_page(html, p, _compile(p), use_cap=True) == [(2, None, None, None, OVER_CAP)]
    p = prof(cap=3)
    assert [r[4] for r in extract_page(html, p, _compile(p), use_cap=True)] == [None]


def test_page_url_fallback_option():
    html = '<article><h1>A page title long enough</h1><p>perex long enough for twenty chars</p></article>'
    assert run(html, prof(title=("h1",), url=(), fallback=True), "https://h.cz/x") == [
        ("A page title long enough", "perex long enough for twenty chars", "https://h.cz/x")]
    assert run(html, prof(title=("h1",), url=()), "https://h.cz/x") == []


def test_unsupported_selector_raises_on_driver():
    with pytest.raises(SelectorError):
        prof(containers=("div > p",))
    with pytest.raises(SelectorError):
        compile_selector("a:first-child")


def test_profiles_have_all_selectors():
    assert sum(len(p.containers) + len(p.title) + len(p.perex) + len(p.url) for p in NEWS_PROFILES) == 1359
    assert sum(p.cap for p in NEWS_PROFILES) == 885


def test_select_one_first_in_document_order():
    doc = Document("<div><p id=1><p id=2></p></p></div>")
    assert select_one(doc, doc.root, compile_selector("p")).get("id") == "1"


def test_quarantine_and_custom_extractor(spark):
    def boom(html):
        raise ValueError("bad page")
    register_profile(Profile("boom", "https://b.cz", 5, ("article",), ("h2",), ("p",), ("a[href]",)))
    pages = spark.createDataFrame(
        [(1, "boom", "b", "https://b.cz", "https://b.cz/", "<article></article>"),
         (2, "t2", "t2", "https://t.cz", "https://t.cz/",
          '<article><h2><a href="/z">Custom long title x</a></h2></article>')],
        "page_id long, profile string, source string, base_url string, url string, html string")
    register_profile(Profile("t2", "https://t.cz", 5, ("article",), ("h2 a",), ("p",), ("h2 a",)))
    arts, rejects, quarantine = extract_articles(pages, extractors={"boom": boom})
    assert [r["url"] for r in arts.collect()] == ["https://t.cz/z"]
    q = quarantine.collect()
    assert len(q) == 1 and q[0]["page_id"] == 1 and "bad page" in q[0]["error"]
    assert get_profile("t2").cap == 5


def test_assign_source_by_host(spark):
    from pressroom.sources.pages import assign_source
    from pressroom.sources.profiles import profiles_df
    pages = spark.createDataFrame(
        [(1, "https://www.aktualne.cz/zpravy/x", "<html></html>"),
         (2, "https://novinky.cz/", "<html></html>"),
         (3, "http://ct24.ceskatelevize.cz/a?b=1", "<html></html>"),
         (4, "https://Unknown.Example.org/p#x", "<html></html>")],
        "page_id long, url string, html string")
    got = {r["page_id"]: (r["profile"], r["source"], r["base_url"])
           for r in assign_source(pages, profiles_df(spark), fallback="page").collect()}
    assert got[1] == ("aktualne", "aktualne", "https://aktualne.cz")
    assert got[2] == ("novinky", "novinky", "https://novinky.cz")
    assert got[3] == ("ct24", "ct24", "https://ct24.ceskatelevize.cz")
    assert got[4] == ("page", "unknown.example.org", "https://unknown.example.org")
    dropped = assign_source(pages, profiles_df(spark))
    assert sorted(r["page_id"] for r in dropped.collect()) == [1, 2, 3]
    # every registered host, with www. and without: one row per page
    hosts = [f"https://{www}{p.host}/x" for p in NEWS_PROFILES for www in ("", "www.", "WWW.")]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(hosts)], "page_id long, url string, html string")
    rows = assign_source(pages, profiles_df(spark)).collect()
    assert sorted((r["page_id"], r["source"]) for r in rows) == [
        (i, NEWS_PROFILES[i // 3].name) for i in range(len(hosts))]


def test_two_profiles_cannot_share_a_host():
    with pytest.raises(ValueError):
        register_profile(Profile("copy", "https://www.novinky.cz", 5, ("article",), ("h2",), ("p",), ("a[href]",)))
    register_profile(Profile("plugin", "https://plugin.example.org", 5, ("article",), ("h2",), ("p",), ("a[href]",)))
    from pressroom.plans.ingest import check_source
    check_source("plugin")


def _stage_pages(n, chars):
    html = "".join(f'<article><h2><a href="/{i}">{"long title " * (chars // 11)}</a></h2></article>' for i in range(4))
    import pandas as pd
    return pd.DataFrame({"page_id": [str(i) for i in range(n)], "profile": ["t"] * n, "source": ["t"] * n,
                         "base_url": ["https://x.cz"] * n, "url": ["https://x.cz/"] * n,
                         "html": [html] * n})


def test_stage_hands_its_rows_on_in_small_batches(monkeypatch):
    """a read batch of many pages is not held as one table of found texts."""
    from pressroom.operators import extract as E
    monkeypatch.setattr(E, "OUT_CHARS", 10_000)
    out = list(E._make_stage({"t": prof()})([_stage_pages(20, 2_000)]))
    assert sum(len(b) for b in out) == 80 and len(out) > 10
    assert max(sum(len(t) for t in b["title"]) for b in out) < 10_000 + 2_000


def test_capped_stage_keeps_every_reject_in_small_batches(monkeypatch):
    """what the cap leaves out is still one row a candidate, and batches stay small."""
    from pressroom.operators import extract as E
    monkeypatch.setattr(E, "OUT_CHARS", 10_000)
    out = list(E._make_stage({"t": prof(cap=3)}, use_cap=True)([_stage_pages(20, 2_000)]))
    errors = [e for b in out for e in b["error"]]
    assert (errors.count(E.OVER_CAP), errors.count(None)) == (20, 60) and len(out) > 5


def test_page_is_parsed_once_for_several_profiles(spark, monkeypatch):
    """twelve profiles cost one parse; what they find alike is one row with their names."""
    from pressroom.operators import extract as E
    from pressroom.operators import htmltree
    html = ('<article class="b"><h2><a href="/1">Title long enough</a></h2></article>'
            '<div class="b"><h2><a href="/2">Another long title</a></h2></div>')
    parses = []

    class Counted(htmltree.Document):
        def __init__(self, html):
            parses.append(1)
            super().__init__(html)
    monkeypatch.setattr(htmltree, "Document", Counted)
    profiles = {"x": prof(), "y": prof(containers=("article", ".b")), "z": prof(cap=0)}
    found = E.extract_with_each(html, ["x", "y", "z", "gone"], profiles, {})
    assert len(parses) == 1
    assert {(r[0], r[1], r[4]): by for r, by in found.items()} == {
        (0, "Title long enough", None): ["x", "y", "z"], (1, "Another long title", None): ["y"],
        (-1, None, "KeyError: 'gone'"): ["gone"]}
    monkeypatch.undo()
    pages = spark.createDataFrame([(1, ["x", "y", "z"], "s", "https://x.cz", "https://x.cz/", html)],
                                  "page_id long, profile array<string>, source string, base_url string, url string, html string")
    arts, _, bad = extract_articles(pages, profiles)
    assert sorted((r["pos"], r["found_by"], r["url"]) for r in arts.collect()) == [
        (0, ["x", "y", "z"], "https://x.cz/1"), (1, ["y"], "https://x.cz/2")] and bad.count() == 0


def test_ingest_over_small_batches_keeps_every_item(spark):
    """the run over pages whose texts leave the stage in several batches counts every article."""
    from pressroom.operators.upsert import empty_articles
    from pressroom.plans.ingest import ingest
    html = "".join(f'<article><h2><a href="/%s-{i}">{"words of title " * 40_000}%s {i}</a></h2></article>' for i in range(4))
    pages = spark.createDataFrame([(p, "listing", "s", "https://x.cz", "https://x.cz/", html.replace("%s", str(p)))
                                   for p in range(3)],
                                  "page_id long, profile string, source string, base_url string, url string, html string")
    res = ingest(pages.coalesce(1), empty_articles(spark), "2024-01-01 00:00:00")
    assert {(r["source"], r["new"], r["updated"]) for r in res.summary.collect()} == {("s", 12, 0), (None, 12, 0)}


def test_read_batch_becomes_strings_in_small_slices(monkeypatch):
    """of a large read batch only some pages at a time are Python strings; a large page comes alone."""
    import pyarrow as pa
    from pressroom.operators import extract as E
    monkeypatch.setattr(E, "IN_BYTES", 1_000)
    html = ["x" * n for n in (400, 600, 1, 5_000, 0, 900)] + [None, "y"]
    batch = pa.RecordBatch.from_pydict({"page_id": list("abcdefgh"), "n": [1, None, 1 << 60, 4, 5, 6, 7, 8], "html": html})
    got = list(E._page_slices(iter([batch, batch.slice(0, 0), batch])))
    assert [list(g["page_id"]) for g in got] == [["a", "b"], ["c"], ["d"], ["e", "f", "g", "h"]] * 2
    assert [h for g in got[:4] for h in g["html"]] == html and list(got[0]["n"]) + list(got[1]["n"]) == [1, None, 1 << 60]


def test_stage_reads_arrow_and_keeps_carried_columns(spark):
    """the stage takes Arrow batches, not pandas ones, and hands carried columns on unchanged."""
    import datetime as dt
    from pressroom.operators.extract import extract_raw
    html = '<article><h2><a href="/1">Title long enough</a></h2></article>'
    day = dt.datetime(2024, 1, 2, 3, 4, 5)
    pages = spark.createDataFrame([((1 << 60) + i, "t", "s", "b", "u", html, None if i % 2 else (1 << 60) + i, day) for i in range(4)],
                                  "page_id long, profile string, source string, base_url string, url string, html string, "
                                  "n long, at timestamp")
    raw = extract_raw(pages.coalesce(1), {"t": prof()}, carry=["n", "at"])
    assert "MapInArrow" in raw._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["page_id"], r["title"], r["n"], r["at"]) for r in raw.collect()) == [
        ((1 << 60) + i, "Title long enough", None if i % 2 else (1 << 60) + i, day) for i in range(4)]


def test_parsed_page_is_given_back_at_once():
    """no element of a page outlives it until Python's search for cycles."""
    import gc
    from pressroom.operators import extract as E
    from pressroom.operators.htmltree import Node
    gc.collect()
    gc.disable()
    try:
        E.extract_with_each('<article><h2><a href="/1">Title long enough</a></h2></article>' * 50, ["t"], {"t": prof()}, {})
        assert not [o for o in gc.get_objects() if isinstance(o, Node)]
    finally:
        gc.enable()
