import random
import re

from pressroom.llm import pii as P
from tests.llm.helpers import docs

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def slow_luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        s += x
    return s % 10 == 0


def slow_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(CARD, t):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and slow_luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, t)
            if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def base(t):
    return [s for s in P.find_spans(t) if s[0] in P.BASE_KINDS]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["@", ".", "a", "b-", "%", "+", "+1", "1", "25", "255", "256", "0", " ", "  ", "-", "(", ")", "\n", "é",
              "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (521) 555-6210", "://", "token"]
    for _ in range(30000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base(t) == slow_spans(t), t


def test_base_spans_of_the_table(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert base(r.text) == slow_spans(r.text)


def test_added_spans_and_masks():
    t = 'token = "24be64439e3e49cf46b2d7c90f" https://bob:pw@host.org/x IBAN: GB82 WEST 1234 5698 7654 32 ssn 123-45-6789'
    kinds = [(k, t[s:e]) for k, s, e in P.find_spans(t)]
    assert ("secret", "24be64439e3e49cf46b2d7c90f") in kinds
    assert ("url", "https://bob:pw@host.org/x") in kinds
    assert ("account", "GB82 WEST 1234 5698 7654 32") in kinds and ("account", "123-45-6789") in kinds
    assert P.mask("mail a.b@c.de now") == "mail [EMAIL] now"
    assert P.mask("x +1 (521) 555-6210") == "x [PHONE]"
    assert P.mask(None) is None and P.mask("") == "" and P.mask("token of joy") == "token of joy"
    assert P.find_spans("https://plain.example.org/a the account of 3 men") == []


def test_long_texts_take_linear_time():
    assert P.find_spans("1" * 300_000) == [] and P.find_spans("a@" * 100_000) == []
    assert P.find_spans("a" * 300_000 + "@b") == []


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.cd"), (3, "é a@b.cd"), (None, "1.2.3.4")]
    got = {(r.doc_id, tuple(map(tuple, r.found))) for r in P.find_pii(docs(spark, rows)).collect()}
    assert got == {(1, ()), (2, ()), (3, (("email", 2, 8),)), (None, (("ip", 0, 7),))}
    d = docs(spark, rows).withColumnRenamed("lang", "found")
    out = P.redact(d)
    assert out.columns == d.columns and out.count() == 5
    assert P.redact(docs(spark, [])).count() == 0


def test_query_columns(spark):
    import hashlib
    from pressroom.llm.queries import q_op10
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q_op10(spark, sf).collect()
    assert len(rows) == len(text) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        want = slow_spans(text[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in P.BASE_KINDS]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in P.find_spans(text[r.doc_id]))


def test_texts_reach_the_parser_without_pandas(spark):
    """Pipeline: a batch of texts is not copied into Python strings as a whole; long batches keep every row in place."""
    import pyarrow as pa
    df = spark.createDataFrame([(1, "mail a@b.cz"), (2, None), (3, "")], "doc_id long, text string")
    for got in (P.redact(df), P.find_pii(df)):
        udf = [c for c in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in c]
        assert len(udf) == 1 and udf[0].rstrip().endswith(", 250")   # PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert {r.doc_id: r.text for r in P.redact(df).collect()} == {1: "mail [EMAIL]", 2: None, 3: ""}
    texts = [None if i % 3 == 0 else f"{i} a{i}@b.cz" for i in range(2 * P.ROWS + 7)]
    seen = []
    got = P._each(pa.array(texts), lambda t: seen.append(t) or P.mask(t), pa.string())
    assert seen == texts and got.to_pylist() == [P.mask(t) for t in texts]
    assert len(P._each(pa.array([], pa.string()), P.mask, pa.string())) == 0
