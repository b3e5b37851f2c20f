"""Sessions and funnels against loops, one user with most events; the stream against the batch, with late events."""

import datetime as dt
import random

from pressroom.operators import sessions as S
from pressroom.session import checkpoint_dir, scratch_path

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, session long, cell long"


def events(seed=0, n=600):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), T0 + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 20)),
             rng.choice("view click purchase error".split()), 7, 7) for i in range(n)]
    edge = [(1000 + i, 9, T0 + dt.timedelta(hours=6 * i, microseconds=i // 3), "view", 7, 7) for i in range(6)]
    same = [(2000 + i, 10, T0, e, 7, 7) for i, e in enumerate("click view purchase click purchase".split())]
    return rows + edge + same


def by_hand(rows, gap=dt.timedelta(hours=6)):
    found = {}
    for user in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))
        number, last = 0, None
        for r in mine:
            number += last is None or r[2] - last > gap
            last = r[2]
            found.setdefault((user, number), []).append(r)
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_sessions_and_funnel(spark):
    checkpoint_dir(spark)
    rows = events()
    d = frame(spark, rows + [(5000, None, T0, "view", 0, 0), (5001, 1, None, "view", 0, 0)])
    want = by_hand(rows)
    got = {(r.user_id, r.session): (r.start, r.last, r.n) for r in S.sessions(d).collect()}
    assert got == {k: (v[0][2], v[-1][2], len(v)) for k, v in want.items()}
    ways = {}
    for k, v in want.items():
        times, steps = [], list(S.STEPS)
        for r in v:
            if steps and r[3] == steps[0]:
                times.append(r[2])
                steps.pop(0)
        ways[k] = (len(times), *times, *[None] * (3 - len(times)))
    got = {(r.user_id, r.session): (r.reached, r.step_1, r.step_2, r.step_3) for r in S.funnel(d).collect()}
    assert got == ways and {w[0] for w in ways.values()} == {0, 1, 2, 3}


def test_repeated_and_empty(spark):
    checkpoint_dir(spark)
    rows = events(2, 50)
    twice = {(r.user_id, r.session): r.n for r in S.sessions(frame(spark, rows + rows)).collect()}
    assert twice == {k: 2 * len(v) for k, v in by_hand(rows).items()}
    none = frame(spark, rows).where("user_id = 99")
    assert S.sessions(none).count() == 0 and S.funnel(none).count() == 0


def test_a_busy_user_leaves_one_row_a_cell(spark):
    d = frame(spark, events())
    plan = S.sessions(d)._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("Window")[-1]  # what stands below the window
    assert "partial_count" in scan and "Python" not in plan


def test_stream_equals_batch_and_drops_what_is_too_late(spark):
    rows = sorted((r for r in events(4, 200) if r[1] < 9), key=lambda r: r[2])
    cut = len(rows) // 2
    late = [r for r in rows[:cut] if rows[cut - 1][2] - r[2] < dt.timedelta(hours=1)][:1]  # late, but in time
    too_late = (7000, 77, T0, "view", 0, 0)
    end = (7001, 78, T0 + dt.timedelta(days=60), "view", 0, 0)  # moves the watermark past all sessions
    drops, out, ckpt = (scratch_path(spark, f"session-{x}") for x in ("drops", "out", "ckpt"))
    first = [r for r in rows[:cut] if r not in late]
    for part in (first, late + [too_late] + rows[cut:], [end], [(7002, 78, end[2], "view", 0, 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(drops)
        S.stream_sessions(spark.readStream.schema(SCHEMA).parquet(drops), out, ckpt).awaitTermination()
    got = spark.read.parquet(out).select("user_id", "start", "last", "n").collect()
    want = S.sessions(frame(spark, rows)).select("user_id", "start", "last", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
