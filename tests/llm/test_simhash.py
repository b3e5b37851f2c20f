import random

import numpy as np
import xxhash

from pressroom.llm import simhash as S
from tests.llm.helpers import docs


def slow_fingerprint(text, k=4):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + k]) for i in range(max(len(ws) - k + 1, 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 9000):
        t = "".join(rng.choice(["Ab ", "c\t", "É\n", "dd  "]) for _ in range(n))
        assert S.fingerprint(t, 4) == slow_fingerprint(t)
    assert S.fingerprint(None, 4) == S.fingerprint(" \n", 4) == 0


def test_thresholds_use_the_whole_budget():
    cost, ts = S.allot([[0, 5, 9], [0, 1, 2], [0, 4, 50]], 3)
    assert sum(t + 1 for t in ts) == 3 and cost == 6 and ts == [-1, 1, 0]


def test_links_of_random_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)  # so that large buckets are cut into a grid
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps += [0, 1, 15, 31] + [rng.getrandbits(64) for _ in range(60)]
    fps = list(dict.fromkeys(fps))
    for distance in (0, 1, 4, 7):
        df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(4)
        edges = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in S.links(df, distance).collect()]
        want = slow_components(list(range(len(fps))), fps, distance)
        at = {f: i for i, f in enumerate(fps)}
        got = list(range(len(fps)))
        for _ in range(len(fps)):
            new = got[:]
            for a, b in edges:
                new[at[a]] = new[at[b]] = min(new[at[a]], new[at[b]])
            if new == got:
                break
            got = new
        assert got == want, distance


def near_copies():
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(80))
            for _ in range(8)]
    rows = []
    for i in range(60):
        ws = base[i % 8].split()
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(80)] = "changed%d" % rng.randrange(9)
        rows.append((100 - i, " ".join(ws)))
    return rows + [(500, None), (501, ""), (502, " \t"), (503, "One two"), (504, "one TWO"), (503, "One two"),
                   (None, rows[0][1]), (None, "alone in the world")]


def test_components_equal_brute_force(spark):
    rows = near_copies()
    got = sorted((r.doc_id or -1, r.fp & (2**64 - 1), r.component_id)
                 for r in S.simhash_components(docs(spark, rows)).collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], fps, 4)
    key = lambda x: (x[0], x[1], -1 if x[2] is None else x[2])
    assert sorted(got, key=key) == sorted(((i or -1, f, c) for (i, _), f, c in zip(rows, fps, want)), key=key)


def test_one_of_each_group_stays(spark):
    rows = near_copies()
    kept = S.drop_near_duplicates(docs(spark, rows).withColumnRenamed("lang", "fp"))
    assert kept.columns == ["doc_id", "text", "fp", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    comp = slow_components([i for i, _ in rows], [slow_fingerprint(t) for _, t in rows], 4)
    want = {i for (i, _), c in zip(rows, comp) if i is not None and c == i}
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 2


def test_empty(spark):
    assert S.simhash_components(docs(spark, [])).count() == 0
    assert S.drop_near_duplicates(docs(spark, [])).count() == 0
    assert S.simhash_components(docs(spark, [(1, None)])).collect()[0].component_id == 1


def test_texts_reach_the_fingerprints_without_pandas(spark):
    """Pipeline: a batch of texts is not copied into Python strings as a whole."""
    from pressroom.llm import simhash
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "doc_id long, text string")
    got = simhash.fingerprints(df)
    udf = [c for c in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in c]
    assert len(udf) == 1 and udf[0].rstrip().endswith(", 250")   # PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert {r.doc_id: r.fp % 2**64 for r in got.collect()} == {
        1: simhash.fingerprint("a b c d e", 4), 2: 0, 3: 0}
