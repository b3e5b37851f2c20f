import html
import re

import numpy as np

from pressroom.llm import html_text as H
from tests.llm.helpers import table_rows

PAGE_TYPE = "page_id long, url string, html string, text string"


def article_text(page):
    """The article of the tables' one template, by cutting it out."""
    end = page.index("</article>") if "</article>" in page else len(page)
    body = page[page.index("<article>") + 9:end]
    parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?p>|</?h1>", body)]
    return "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract_pages(pages, H.train(pages, 60)).collect()}
    for r in pages.collect():
        want = article_text(r.html)
        assert got[r.page_id] == (want, len(want))


def test_other_templates(spark):
    m = H.fit([r.html for r in table_rows(spark, "/root/testdata/sf0.001", "pages")])
    page = ('<html><body><header><h1>Site</h1><a href=/>home</a></header><div id="cookie-banner">We use cookies. '
            'Accept, please.</div><div class="sidebar"><ul><li><a>x</a></li></ul></div><div class="post-content"><h1>'
            'Title here</h1><p>First, with text.</p><p>Second &amp; last; yes.<br>More.</p><div class="ad">Buy now. '
            'It is good.</div></div><section class="comments"><h3>Comments</h3><p>I think, this is wrong. Really.</p>'
            '</section><footer><p>Copyright 2020, all rights.</p></footer></body></html>')
    assert m.extract(page) == "Title here\nFirst, with text.\nSecond & last; yes. More."
    page = ('<main><article><header><h1>T</h1></header><p>One, <i>here</i>.<script>x</script><aside>Related, things.'
            '</aside><form><label>Name</label><input></form><div class="comments"><p>No. Yes.</p></div></article></main>')
    assert m.extract(page) == "T\nOne, here."
    assert m.extract("a &lt;b&gt;  c") == "a <b> c" and m.extract(None) == m.extract("") == ""
    assert m.extract("<div>" * 5000 + "<p>deep text, here.") == "deep text, here."
    assert m.extract("</p></b><nav><a>x</a>") == ""


def test_marginals_equal_enumeration():
    m = H.Model({"tag:p": 1.2, "tag:div": -0.7, "long": 0.3}, ((0.8, 0.2), (0.3, 0.7)))
    blocks = H.parse("<div>abc<p>some text<div><p>x</p></div><p>y</div><p>z</p>")
    n = len(blocks)
    z = [sum(m.weights.get(k, 0) * v for k, v in H.features(b).items()) for b in blocks]
    on, total = np.zeros(n), 0.0
    for state in range(1 << n):
        s = [(state >> i) & 1 for i in range(n)]
        p = np.prod([np.exp(z[i] * s[i]) for i in range(n)])
        p *= np.prod([m.pairs[s[b.parent]][s[i]] for i, b in enumerate(blocks) if b.parent >= 0])
        total += p
        on += p * np.array(s)
    assert np.allclose(m.marginals(blocks), on / total)


def test_frames(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>Hi, all.", "t"), (3, "u", "<p>Hi, all.", "t")]
    d = spark.createDataFrame(rows, PAGE_TYPE)
    out = H.extract_pages(d, H.train(d)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "", 0), (2, "", 0), (3, "Hi, all.", 8),
                                                                   (3, "Hi, all.", 8)]
    assert H.extract_pages(d.limit(0), H.train(d.limit(0))).count() == 0


FRAMES = [  # with an article, with classes only, with a main element and comments that are articles
    '<html><body><nav><a>x</a></nav><article><h1>T</h1>%(part)s<p>%(end)s</p></article><footer>c</footer></body></html>',
    '<html><body><div class="navbar"><a>x</a></div><div class="wrap"><h1>T</h1>%(part)s<p>%(end)s</p></div>'
    '<div class="site-footer">Copyright, all rights.</div></body></html>',
    '<body><div id="siteHeader"><h1>Site</h1></div><main><h1>T</h1>%(part)s<p>%(end)s</p><section class="comments">'
    '<article class="comment"><p>I think, so. Really it is long, and so on.</p></article></section></main>',
    '<body><table><tr><td class=left-menu><a>x</a> <a>y</a></td><td><h1>T</h1>%(part)s<p>%(end)s</p></td></tr></table>']
END = "This is the end of it, told at some length, as texts are; then it stops, and that is all."


def test_words_inside_names_and_stray_quotes_lose_no_text(spark):
    m = H.fit([r.html for r in table_rows(spark, "/root/testdata/sf0.001", "pages")])
    war = "Words about the war, and more. " * 25
    for part, want in [('<div class="share-price"><p>Share price rose, they said.</p></div>', "Share price rose, they said."),
                       ('<section id="search-engines"><p>Engines, old ones.</p></section>', "Engines, old ones."),
                       ('<div class="form-of-government"><p>Forms, all.</p></div>', "Forms, all."),
                       ('<h2 id="notice-of-change">Notice of change</h2>', "Notice of change"),
                       ('<h2 id="comments">On comments</h2>', "On comments"),
                       (f'<div id="comments-on-the-war"><p>{war}</p></div>', war.strip()),
                       ("<p>Let <math><mi>x</mi></math> be.</p>", "Let x be."),
                       ("<p title=Bob's>first text, here.</p><p title=Ann's>second text, here.</p>",
                        "first text, here.\nsecond text, here."),
                       ('<p data-a="x > y" title=\'a"b\'>quoted, well.</p>', "quoted, well."),
                       ('<p>A <span class="share-price">12</span> and <span class="text">13</span>.</p>', "A 12 and 13."),
                       ('<div class="ad">Buy now. It is good.</div>', None),
                       ('<ul class="share-buttons"><li><a href=/x>Tell all</a></li></ul>', None)]:
        for frame in FRAMES:
            assert m.extract(frame % {"part": part, "end": END}) == "\n".join(x for x in ("T", want, END) if x), (part, frame)


def test_attributes_without_an_end_are_read_in_one_go():
    assert H.parse('<p title="' + "x " * 200_000)
    assert H.parse("<p " + "a='b' " * 100_000) and H.parse("<p " * 50_000)


def test_main_text_is_found_where_nothing_marks_it(spark):
    """The table's pages with the mark of their main element taken off: the truth is known from it."""
    pages = [r.html for r in table_rows(spark, "/root/testdata/sf0.001", "pages") if r.html and "<article>" in r.html]
    m = H.fit(pages)
    n = right = 0
    for page in pages:
        truth = H.parse(page)
        blocks = H.parse(page.replace("<article>", "<div>").replace("</article>", "</div>"))
        assert len(truth) == len(blocks)
        for b, t, chance in zip(blocks, truth, m.marginals(blocks)):
            if H._line(b):
                n += 1
                right += (chance > 0.5) == (t.in_main or t.tag == "article")
    assert n > 400 and right >= 0.99 * n


def test_messages_overrule_single_blocks(spark):
    """A paragraph that is one link looks like a menu by itself; among content it is content, and stays out elsewhere."""
    m = H.fit([r.html for r in table_rows(spark, "/root/testdata/sf0.001", "pages")])
    link = "<p><a href=/r>Read the report</a></p>"
    blocks = H.parse(f"<div><h1>T</h1><p>{END}</p>{link}<p>{END}</p></div><div>{link}{link}</div>")
    own = [sum(m.weights.get(k, 0) * v for k, v in H.features(b).items()) > 0 for b in blocks]
    got = [x > 0.5 for x in m.marginals(blocks)]
    links = [i for i, b in enumerate(blocks) if H._line(b) == "Read the report"]
    assert [own[i] for i in links] == [False] * 3 and [got[i] for i in links] == [True, False, False]


def test_labels_come_from_recurring_text_not_from_names():
    pages = [f"<article><h1>H{i}</h1><p>Own text {i}, here.</p><p>Read our other pages, too.</p>"
             f"<div class=notice>n{i}</div></article><div>out {i}</div>" for i in range(4)]
    parsed = [H.parse(p) for p in pages]
    labels = H.labels_of(parsed[0], H.headings_of(parsed))
    assert [(H._line(b), y) for b, y in zip(parsed[0], labels)] == [
        ("", 0), ("", 1), ("H0", 1), ("Own text 0, here.", 1), ("Read our other pages, too.", 0), ("n0", None), ("out 0", 0)]
    assert H.labels_of(H.parse("<p>x"), {}) is None
