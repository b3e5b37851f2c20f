"""Conversation repair against an enumeration of all edit scripts, whole and in pieces."""

import hashlib
import itertools
import random
import re

import pytest

from pressroom.llm import conversation as C

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def enumerated(tokens, inserts=3):
    """(cost, audit) over every edit script with at most ``inserts`` inserts in a gap."""
    best = None
    n = len(tokens)
    gap = ["".join(p) for k in range(inserts + 1) for p in itertools.product("ua", repeat=k)]
    per_row = []
    for t in tokens:
        ways = [("D", 3, "")]
        if t != "-":
            extra = 1 if t.isupper() else 0
            ways.append(("K", extra, t.lower()))
            ways += [("R", 2 + extra, r) for r in "ua"]
        per_row.append(ways)
    for rows in itertools.product(*per_row):
        base = sum(c for _, c, _ in rows)
        if best and base > best[0]:
            continue
        for ins in itertools.product(gap, repeat=n + 1):
            cost = base + 2 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            out = ins[0] + "".join(r + i for (_, _, r), i in zip(rows, ins[1:]))
            if PATTERN.match(out):
                audit = "I" * len(ins[0]) + "".join(x + "I" * len(i) for (x, _, _), i in zip(rows, ins[1:]))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_conversation(n):
    for tokens in itertools.product("suaxSUAX-", repeat=n):
        t = "".join(tokens)
        assert C.repair(t) == enumerated(t, 3), t
    for tokens in random.Random(n).sample([*itertools.product("suaxSUAX-", repeat=3)], 40):
        t = "".join(tokens)
        assert C.repair(t) == enumerated(t, 2), t


def test_longer_conversations_against_plain_programming():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("uauauasxUA-") for _ in range(rng.randrange(0, 40)))
        best = {C.START: (0, "")}

        def relaxed(best):
            for _ in range(4):
                for q in list(best):
                    c, x = best[q]
                    to = C.NEXT[q][1]
                    best[to] = min(best.get(to, (9**9, "")), (c + 2, x + "I"))
            return best

        for tok in t:
            new = {}
            for q, (c, x) in relaxed(best).items():
                for to in range(4):
                    for e, letter in C.row_edge(tok, q, to):
                        new[to] = min(new.get(to, (9**9, "")), (c + e, x + letter))
            best = new
        best = relaxed(best)
        want = min(best[q] for q in (C.START, C.DONE) if q in best)
        assert C.repair(t) == want
        for size in (1, 3, 7):
            level = [C.solve_piece(C.Rows(t[i:i + size])) for i in range(0, len(t), size)] or [C.solve_piece(C.Rows(""))]
            while len(level) > 1:
                level = [C.solve_piece(C.Pieces(level[i:i + 3])) for i in range(0, len(level), 3)]
            assert min((c, x) for a, b, c, x in level[0] if a == C.START and b in (C.START, C.DONE)) == want


def test_legal_conversations_cost_nothing():
    for t in ("", "ua", "sua", "uaua", "suaua"):
        assert C.repair(t) == (0, "K" * len(t))


SCHEMA = "conv_id long, turn long, role string, text string, _big string, count string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(3)


def by_hand(rows):
    """The report of one conversation, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] if r[1] is not None else " ").encode(),
                                       (r[2] if r[2] is not None else " ").encode()))
    seen, tokens, n = set(), "", dict(blank=0, duplicate=0, truncated=0)
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    for _, r, x in clean:
        body = re.findall(r"[^\x20\x09-\x0D]", x)
        c = r[:1] if r[:1] in ("s", "u", "a") else "x"
        fault = ("blank" if not body else "duplicate" if (r, x) in seen else
                 "truncated" if body[-1] not in ".!?" else None)
        seen.add((r, x))
        if fault:
            n[fault] += 1
        tokens += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
    turns = {t for t, _, _ in clean if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(clean, clean[1:]))
    cost, audit = C.repair(tokens)
    out, it = [], iter(clean)
    odd = (len(audit) - audit.count("D")) % 2
    for x in audit:
        _, r, t = (None, "", "") if x == "I" else next(it)
        if x == "D":
            continue
        out.append(f"{r if x == 'K' else ['user', 'assistant'][(len(out) - odd) % 2]}:{t}")
    assert PATTERN.match("".join(o[:1] for o in out))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(rng, convs, most):
    rows = []
    for c in convs:
        for _ in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([None, *range(most)]), rng.choice(["system", "user", "assistant", "tool", None, ""]),
                         rng.choice(["Hi.", "So", "", None, " \n", "é?", "Ja!", "Long " * 400 + "."])))
    return rows


@pytest.mark.parametrize("piece", [512, 3])
def test_reports_equal_row_by_row(spark, piece):
    rng = random.Random(piece)
    rows = random_rows(rng, [*range(12), None, -4], 60 if piece == 3 else 12)
    got = {r[0]: tuple(r[1:]) for r in C.repair_conversations(rows_of(spark, rows), piece=piece).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = by_hand([r[1:] for r in rows if r[0] == c])
    assert got == want


def test_one_conversation_of_many_equal_rows(spark):
    rows = [(7, None, "user", "Same.")] * 400 + [(7, 1, "assistant", "Yes.")] + [(8, 0, "user", "Hi.")]
    got = {r.conv_id: r for r in C.repair_conversations(rows_of(spark, rows), piece=16).collect()}
    assert got[7].duplicate == 399 and got[7].cost == 3 * 399
    assert tuple(got[7])[1:] == by_hand([r[1:] for r in rows if r[0] == 7])
    assert (got[8].cost, got[8].audit) == (2, "KI")


def test_damage_by_crc(spark):
    import zlib
    rows = [(c, t, r, x) for c in range(60) for t, r, x in ((0, "user", "Hi. You!"), (1, "assistant", None))]
    got = sorted(map(tuple, C.damage(rows_of(spark, rows)).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        k, x = zlib.crc32(f"{c}:{t}".encode()) % 20, " " if x is None else x
        new = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x, k != 0)
        want += [new] * (2 if k == 3 else 1)
    assert got == sorted(want, key=str)


def test_dropped_conversations_stay_and_empty_tables_give_nothing(spark):
    import zlib
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = C.damage(rows_of(spark, [(c, 0, "user", "Hi.")]))
    row = C.repair_conversations(df, present="present").first()
    assert tuple(row) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair_conversations(rows_of(spark, [(1, 0, "user", "Hi.")]).limit(0)).count() == 0


def test_repaired_rows(spark):
    df = rows_of(spark, [(1, 0, "assistant", "A."), (1, 1, "assistant", "B.")])
    got = [tuple(r) for r in C.repaired_rows(df).orderBy("position").collect()]
    assert [r[1:] for r in got] in ([(0, "user", "A."), (1, "assistant", "B.")],)
