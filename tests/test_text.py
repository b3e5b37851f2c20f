"""Hand-written cases for the scalar functions and the search predicate."""

import pytest
from pyspark.sql import functions as F

from pressroom.functions import text as TX
from pressroom.functions.search import search_predicate
from pressroom.operators import listing as LS

NBSP = " "
IDEO = "　"


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_text(spark):
    got = _one(spark, TX.clean_text, [None, "", " a\n\tb ", f"{NBSP}x y{NBSP}", "\r\nq\r\n"])
    assert got == ["", "", "a  b", "x y", "q"]
    for v in [" a\n\tb ", f"{NBSP}x y{NBSP}", "\r\nq\r\n"]:
        assert TX.clean_text_py(v) == _one(spark, TX.clean_text, [v])[0]


def test_normalize_url(spark):
    cases = {"": "", "/a": "https://x.cz/a", "a": "https://x.cz/a", "//c.cz/a": "https://x.cz//c.cz/a",
             "#t": "https://x.cz/#t", "mailto:q@x.cz": "https://x.cz/mailto:q@x.cz", "http://o.cz/a": "http://o.cz/a"}
    got = _one(spark, lambda c: TX.normalize_url(c, "https://x.cz/"), list(cases))
    assert got == list(cases.values())
    assert _one(spark, lambda c: TX.normalize_url(c, "https://x.cz"), [None]) == [""]


def test_normalize_title(spark):
    cases = {"! Hello  World!": " hello world", "ábc café": "ábc café", "x² ½ y": "x² ½ y",
             "‿conn_ector": "conn_ector", f"{NBSP}{IDEO}Ab{IDEO}": "ab"}
    assert _one(spark, TX.normalize_title, list(cases)) == list(cases.values())


def test_title_hash_matches_python(spark):
    import hashlib
    vals = ["Hello, World!", "  Příliš žluťoučký kůň  ", "a\tb\nc", "x² ½ y — z"]

    norm = ["hello world", "příliš žluťoučký kůň", "a b c", "x² ½ y z"]
    assert _one(spark, TX.title_hash, vals) == [hashlib.md5(n.encode()).hexdigest() for n in norm]


def test_classify_error(spark):
    vals = ["Connection TIMEOUT while", "NS_ERROR_UNKNOWN_HOST timeout", "connection refused", "boom"]
    assert _one(spark, TX.classify_error, vals) == ["timeout", "dns", "connection", "other"]


def test_labels(spark):
    import datetime as dt
    df = spark.createDataFrame([("ct24", dt.datetime(2024, 3, 5, 7, 9))], "s string, t timestamp_ntz")
    r = df.select(TX.source_label("s"), TX.scraped_label("t")).first()
    assert tuple(r) == ("Ct24", "05.03.2024 07:09")


def test_search_semantics(spark):
    rows = [(1, "KŮŇ", None), (2, "ABC", "x"), (3, "axb", ""), (4, "back\\slash", "y"), (5, "plain", "p")]
    df = spark.createDataFrame(rows, "id long, title string, perex string")

    def ids(q):
        return sorted(r[0] for r in df.filter(search_predicate(q)).select("id").collect())
    assert ids("ůň") == []
    assert ids("b") == [2, 3, 4]
    assert ids("a_b") == [3]
    assert ids("%") == [1, 2, 3, 4, 5]
    assert ids("\\") == [4]
    assert search_predicate("") is None and search_predicate(None) is None


def test_listing_bounds():
    with pytest.raises(ValueError):
        LS.ListingParams(page=0)
    with pytest.raises(ValueError):
        LS.ListingParams(limit=101)
    with pytest.raises(ValueError):
        LS.ListingParams(limit=0)
    assert LS.ListingParams(page=3, limit=7).offset == 14


def test_random_strings_match_python(spark):
    """clean_text, normalize_title and title_hash against their Python definitions
    on random strings over Czech letters, Unicode whitespace, punctuation, digits and
    numeric symbols."""
    import hashlib
    import random
    import re
    alphabet = (list("abcxyzABCXYZ0189_") + list("áčďéěíňóřšťúůýžÁČŘŠŽ") + list("½²³")
                + [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　"]
                + list("!?.,;:-–—\"'()[]{}%&*/\\@#$"))
    rnd = random.Random(5)
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]

    # per character: what is white space, and what a word character
    def stripped(t):
        chars = list(t)
        while chars and chars[0].isspace():
            del chars[0]
        while chars and chars[-1].isspace():
            del chars[-1]
        return chars

    def py_clean(t):
        return "".join(" " if c in "\n\r\t" else c for c in stripped(t))

    def py_norm(t):
        out = []
        for c in stripped(t.lower()):
            if c.isspace():
                if not out or out[-1] != " ":
                    out.append(" ")
            elif c.isalnum() or c == "_":
                out.append(c)
        return "".join(out)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = df.orderBy("i").select(TX.clean_text("v"), TX.normalize_title("v"), TX.title_hash("v")).collect()
    for v, (c, n, h) in zip(vals, got):
        assert c == py_clean(v), repr(v)
        assert n == py_norm(v), repr(v)
        assert h == hashlib.md5(py_norm(v).encode()).hexdigest(), repr(v)
