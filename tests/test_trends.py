"""Windows and bursts against loops; the stream against the batch, with late articles."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

from pressroom.operators import trends as T
from pressroom.session import scratch_path

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "id long, title string, scraped_at timestamp_ntz, w string, n long"


def articles(seed=0, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h = rng.randrange(0, 120)
        w = [rng.choice("red blue green the".split()) for _ in range(4)] + ["the"]
        if 30 <= h < 48:
            w += ["quake"]
        if 60 <= h < 66 and rng.random() < 0.7:
            w += ["Quake"]
        rows.append((i, " ".join(w), T0 + dt.timedelta(hours=h, minutes=rng.randrange(60)), "x", 0))
    return rows


def windows_by_hand(rows, hours=6):
    c = Counter()
    for _, t, at, *_ in rows:
        if at is not None:
            s = T0 + dt.timedelta(hours=(at - T0) // dt.timedelta(hours=1) // hours * hours)
            c.update((s, w) for w in {"", *(t or "").lower().split()})
    return c


def bursts_by_hand(counts, hours=6, min_articles=20):
    d = {s: n for (s, w), n in counts.items() if w == ""}
    first = min(d)
    n = (max(d) - first) // dt.timedelta(hours=hours) + 1
    starts = [first + dt.timedelta(hours=hours * t) for t in range(n)]
    out = []
    for w in {w for _, w in counts} - {""}:
        r = [counts.get((s, w), 0) for s in starts]
        if sum(r) < min_articles:
            continue
        p = [min(sum(r) / sum(d.values()), 0.9999 / 2)]
        p.append(p[0] * 2)
        cost = lambda q, t: -(r[t] * math.log(p[q]) + (d.get(starts[t], 0) - r[t]) * math.log(1 - p[q]))
        best = {0: (0.0, []), 1: (math.inf, [])}
        for t in range(n):
            new = {}
            for q in (0, 1):
                ways = [(best[o][0] + (math.log(n) if q > o else 0), o) for o in (q, 1 - q)]
                c, o = ways[0] if ways[0][0] <= ways[1][0] else ways[1]
                new[q] = (c + cost(q, t), best[o][1] + [q])
            best = new
        states = best[0][1] if best[0][0] <= best[1][0] else best[1][1]
        for on, run in itertools.groupby(range(n), key=lambda t: states[t]):
            run = list(run)
            if on:
                out.append((w, starts[run[0]], starts[run[-1]] + dt.timedelta(hours=hours), len(run), sum(r[t] for t in run)))
    return sorted(out)


def test_windows_and_bursts(spark):
    rows = articles() + [(900, None, T0, "x", 0), (901, "the", None, "x", 0), (0, *articles()[0][1:])]
    counts = T.term_windows(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = windows_by_hand(rows)
    assert {(r.start, r.term): r.n for r in counts.collect()} == dict(want)
    got = sorted(map(tuple, T.term_bursts(counts).collect()))
    assert got == bursts_by_hand(want)
    assert ("quake", T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=48)) in [g[:3] for g in got]


def test_empty(spark):
    counts = T.term_windows(spark.createDataFrame([], SCHEMA))
    assert counts.count() == 0 and T.term_bursts(counts).count() == 0


def test_stream_equals_batch_and_drops_what_is_too_late(spark):
    rows = sorted(articles(4, 300), key=lambda r: r[2])
    cut = len(rows) // 2
    late = [r for r in rows[:cut] if rows[cut - 1][2] - r[2] < dt.timedelta(hours=10)][::7]  # late, but in time
    too_late = (5000, "ancient", T0, "x", 0)
    end = (5001, "end", T0 + dt.timedelta(days=30), "x", 0)  # moves the watermark past all windows
    drops, out, ckpt = (scratch_path(spark, f"trend-{x}") for x in ("drops", "out", "ckpt"))
    first = [r for r in rows[:cut] if r not in late]
    for part in (first, late + [too_late] + rows[cut:], [end], [(5002, "end", end[2], "x", 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(drops)
        T.stream_term_windows(spark.readStream.schema(SCHEMA).parquet(drops), out, ckpt).awaitTermination()
    got = spark.read.parquet(out)
    batch = T.term_windows(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.where("term = 'ancient'").count() == 0
    assert sorted(map(tuple, T.term_bursts(got).collect())) == sorted(map(tuple, T.term_bursts(batch).collect()))
