import random
import re

from pressroom.llm import decontaminate as D
from pressroom.llm import quality as Q
from tests.llm.helpers import docs


def slow_features(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i:i + 8]), []).append(i)
    hit = {j for s in seen.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)),
            len(hit))


def slow_kept(t):
    n, chars, sym, lines, dup, rep = slow_features(t)
    return not (n < 20 or 100 * rep > 30 * n or 100 * sym > 5 * chars or 100 * dup > 50 * lines or chars < 2 * n
                or chars > 15 * n)


def slow_contaminated(t, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                 re.sub("[A-Z]", lambda m: m.group().lower(), x or ""))
    ws, hit, ids = words(t), set(), set()
    for item, text in items:
        iw = words(text)
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(ws) - n + 1):
                if ws[j:j + n] == iw[i:i + n]:
                    hit.update(range(j, j + n))
                    ids.add(item)
    return len(ws), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(ws)


def texts(rng, n=60):
    out = [None, "", " \n\t", "one", "é É x", "a\x0bb\x0cc\rd\n\n#|$ e"]
    for _ in range(n):
        ws = [rng.choice(["a", "b", "the", "É", "x#", "10", "c\n", "\n"]) for _ in range(rng.randrange(1, 90))]
        out.append(rng.choice([" ", "  ", "\t"]).join(ws))
    return out + [" ".join(f"u{i}" for i in range(30_000)), "same line here now\n" * 900]


def test_features_and_verdict(spark):
    rows = list(enumerate(texts(random.Random(2)))) + [(3, "one"), (3, "one"), (None, "x y")]
    got = sorted(map(tuple, Q.quality_report(docs(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        n, chars, sym, lines, dup, rep = slow_features(t)
        want.append((i, n, chars, sym, lines, dup, rep, n < 20 or 100 * rep > 30 * n, slow_kept(t)))
    assert got == sorted(want, key=str)


def test_filter_in_any_order(spark):
    rows = list(enumerate(texts(random.Random(3))))
    d = docs(spark, rows).withColumnsRenamed({"lang": "q_words", "source": "Rejected_By"})
    want = sorted(i for i, t in rows if slow_kept(t))
    for order in (Q.RULES, Q.RULES[::-1], None):
        out = Q.quality_filter(d, order=order)
        assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == want
    assert Q.quality_filter(d.limit(0)).count() == 0
    est = Q.estimate(d)
    assert {e["rule"] for e in est} == {r.name for r in Q.RULES} and all(0 <= e["rejects"] <= 1 for e in est)


def test_order_is_by_rejections_per_cost():
    est = [{"rule": r.name, "cost": c, "rejects": x} for r, c, x in zip(Q.RULES, (1, 1, 2, 1, 1), (.1, .2, .6, .2, 0))]
    assert [r.name for r in Q.order_rules(est)] == ["symbols", "repeats", "dup_lines", "min_words", "word_length"]


def test_contamination(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(7)] + ["É", "9"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, make(20)), (2, make(13)), (3, make(5)), (4, make(1) + "z"), (5, None), (6, "..."), (7, make(12)),
             (None, make(15)), (8, make(40)), (9, make(40))]
    items += [(10, items[0][1]), (10, items[0][1])]
    rows = [(0, None), (1, ""), (2, "!!"), (3, make(12))]
    for i in range(4, 60):
        k = rng.randrange(len(items))
        src = (items[k][1] or "").split()
        lo = rng.randrange(len(src) + 1)
        part = " ".join(src[lo:lo + rng.choice([5, 12, 13, 14, 30])]).upper().replace("É", "É")
        rows.append((i, make(rng.randrange(60)) + "-" + part + ", " + make(rng.randrange(60))))
    rows += [rows[5], (5, make(8)), (None, rows[6][1])]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated)
                  for r in D.contamination(docs(spark, rows).withColumnRenamed("lang", "fp"), b).collect()), key=str)
    assert got == sorted({str(x): x for x in ((i, *slow_contaminated(t, items)) for i, t in rows)}.values(), key=str)
    d = docs(spark, rows)
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i, t in rows if not slow_contaminated(t, items)[3])
    none = D.contamination(d, b.limit(0)).collect()
    assert not any(r.n_hit or r.contaminated for r in none)
    assert D.contamination(d.limit(0), b).count() == 0
