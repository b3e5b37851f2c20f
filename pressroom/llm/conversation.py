"""Conversation structure repair: a bidirectional Dijkstra search over the edit lattice of each conversation.

A lattice node is (rows consumed, state of the pattern ``(s?(ua)+)?``).  Row edges keep (0), rerole (2) or delete (3) a
row, an undeleted truncated row costs 1 more, blank and duplicate rows can only be deleted; an insert edge (2) adds an
empty user or assistant row.  A forward heap from the start and a reverse heap from the accepting end meet; both go on
until no path of equal cost can be missing, and the least concatenated audit over all crossings wins.  A node's label is
(cost, least audit): audits of one node and cost are never proper prefixes of each other (a longer one would hold more
paid inserts), so least parts concatenate to the least whole.

Plan: one shuffle by conversation, rows streamed in order, one conversation in memory.  Conversations of over ``PIECE``
rows never meet in one group: their rows are range-partitioned by their order, cut into pieces, each piece is solved from
every state to every state, and pieces are joined ``FAN`` at a time by the same search until one is left; only the
digest of such a conversation is one stream, as a hash is.

Defined results: NULL role or text count as one space, a NULL turn sorts first and is ignored by ``gaps``, a NULL
conversation id is a conversation; rows of one turn are ordered by role, then text; repeated rows are duplicates; an empty
role has no initial and can't be kept; a conversation without rows gives zeros, an empty audit and the digest of the
empty string; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.llm.common import checkpointed, small_side

#: Rows a conversation may have to be searched whole, and pieces joined at a time.
PIECE, FAN = 512, 64
START, SYSTEM, USER, DONE = range(4)
#: The role each state asks for next, and the state it leads to; a system row may also open.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", DONE), DONE: ("u", USER)}
BEFORE = {USER: (START, SYSTEM, DONE), DONE: (USER,)}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


def row_edge(token: str, state: int, to: int):
    """(cost, letter) pairs that lead over a row from ``state`` to ``to``.  A token is the row's initial, upper case if
    the row is truncated, or "-" for a row that has to go."""
    if state == to:
        yield DELETE, "D"
    if token == "-":
        return
    extra, initial = (TRUNCATED if token.isupper() else 0), token.lower()
    if state == START and to == SYSTEM and initial == "s":
        yield KEEP + extra, "K"
    if NEXT[state][1] == to:
        if initial == NEXT[state][0]:
            yield KEEP + extra, "K"
        else:
            yield REROLE + extra, "R"


@lru_cache(maxsize=None)
def _row_table(token: str) -> dict:
    return {s: [(c, x, t) for t in range(4) for c, x in row_edge(token, s, t)] for s in range(4)}


@lru_cache(maxsize=None)
def _row_table_back(token: str) -> dict:
    return {t: [(c, x, s) for s in range(4) for c, x in row_edge(token, s, t)] for t in range(4)}


class Rows:
    """The edit lattice of rows given as tokens."""

    def __init__(self, tokens: str):
        self.tokens, self.n = tokens, len(tokens)

    def forward(self, i: int, q: int):
        if i < self.n:
            for cost, letters, to in _row_table(self.tokens[i])[q]:
                yield cost, letters, i + 1, to
        yield INSERT, "I", i, NEXT[q][1]

    def backward(self, i: int, q: int):
        if i > 0:
            for cost, letters, to in _row_table_back(self.tokens[i - 1])[q]:
                yield cost, letters, i - 1, to
        for p in BEFORE.get(q, ()):
            yield INSERT, "I", i, p


class Pieces:
    """The lattice of solved pieces: each is a list of (from, to, cost, audit)."""

    def __init__(self, pieces: list[list[tuple]]):
        self.pieces, self.n = pieces, len(pieces)

    def forward(self, i: int, q: int):
        if i < self.n:
            for a, b, cost, audit in self.pieces[i]:
                if a == q:
                    yield cost, audit, i + 1, b

    def backward(self, i: int, q: int):
        if i > 0:
            for a, b, cost, audit in self.pieces[i - 1]:
                if b == q:
                    yield cost, audit, i - 1, a


class _Side:
    """One search direction: tentative labels, settled nodes and the heap.  The heap's order (cost, layers done) settles
    a node after all that reach it at the same cost, since only edges between layers can be free."""

    def __init__(self, layer: int, states, step: int):
        self.best = {(layer, q): (0, "") for q in states}
        self.done: set = set()
        self.heap = [(0, 0, layer, q) for q in states]
        self.step, self.origin = step, layer

    def top(self):
        while self.heap and (self.heap[0][2], self.heap[0][3]) in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def offer(self, node, cost, audit):
        old = self.best.get(node)
        if old is None or (cost, audit) < old:
            self.best[node] = (cost, audit)
            if old is None or cost < old[0]:
                heappush(self.heap, (cost, abs(node[0] - self.origin), *node))


def search(lattice, start: int, goals) -> tuple[int, str] | None:
    """(cost, least audit) from ``start`` before the first row to any of ``goals`` after the last; None if there is
    no way."""
    ahead, back = _Side(0, (start,), 1), _Side(lattice.n, goals, -1)
    limit = None
    if lattice.n == 0 and start in goals:
        limit = 0
    while True:
        a, b = ahead.top(), back.top()
        if a is None or b is None or (limit is not None and a + b > limit):
            break
        side, other, edges = (ahead, back, lattice.forward) if a <= b else (back, ahead, lattice.backward)
        _, _, i, q = heappop(side.heap)
        side.done.add((i, q))
        cost, audit = side.best[i, q]
        for c, letters, j, to in edges(i, q):
            side.offer((j, to), cost + c, audit + letters if side is ahead else letters + audit)
            if (j, to) in other.best:
                total = cost + c + other.best[j, to][0]
                limit = total if limit is None or total < limit else limit
    if limit is None:
        return None
    final = back.done | {(lattice.n, g) for g in goals}
    found = []
    for node in ahead.done | {(0, start)}:
        cost, audit = ahead.best[node]
        if node in final and cost + back.best[node][0] == limit:
            found.append(audit + back.best[node][1])
        for c, letters, j, to in lattice.forward(*node):
            if (j, to) in final and cost + c + back.best[j, to][0] == limit:
                found.append(audit + letters + back.best[j, to][1])
    return limit, min(found)


@lru_cache(maxsize=1 << 16)
def repair(tokens: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a whole conversation; many conversations share their tokens."""
    return search(Rows(tokens), START, (START, DONE))


def solve_piece(lattice) -> list[tuple]:
    """(from, to, cost, audit) for every pair of states that a piece connects."""
    out = []
    for a in range(4):
        for b in range(4):
            got = search(lattice, a, (b,))
            if got:
                out.append((a, b, *got))
    return out


def initial(role: str) -> str:
    return role[:1] or "-"


def token(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(token, first fault or "") of a row."""
    body = text.rstrip(SPACE)
    if not body:
        return "-", "blank"
    if seen:
        return "-", "duplicate"
    c = initial(role)
    c = c if c in "sua" else "x"
    return (c, "") if body[-1] in ".!?" else (c.upper(), "truncated")


def apply_audit(audit: str, rows, length: int | None = None, at: int = 0):
    """The repaired (role, text) pairs; ``rows`` is an iterator, taken as far as ``audit`` asks.  ``length`` is that of
    the whole repaired conversation (it fixes whether a system row opens) and ``at`` the place the audit begins at."""
    length = len(audit) - audit.count("D") if length is None else length
    for x in audit:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        if x != "K":
            role = NAMES["ua"[(at - length % 2) % 2]]
        at += 1
        yield role, text


def _digest(pairs, hasher=None, first=True):
    hasher = hasher or hashlib.sha256()
    for role, text in pairs:
        hasher.update((("" if first else "\n") + role + ":" + text).encode())
        first = False
    return hasher, first


# ---------------------------------------------------------------------------------------------- Spark side

REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def prepared(rows: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, present; NULL role and text become one space.  Rows whose column ``present`` is false
    only make their conversation known."""
    present = F.col(present) if present else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"),
                       present.alias("present"))


def _stream(batches, columns):
    """Rows of sorted batches as tuples, one at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _groups(rows):
    """(key, iterator) runs of equal first fields."""
    from itertools import groupby
    return groupby(rows, key=lambda r: r[0])


class _Out:
    """Collects output rows and gives them back in Arrow batches of at most ``size`` rows."""

    def __init__(self, schema: pa.Schema, size: int = 2000):
        self.schema, self.size, self.rows = schema, size, []

    def add(self, *row):
        self.rows.append(row)
        if len(self.rows) >= self.size:
            yield self.flush()

    def flush(self):
        cols = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, self.schema.types)], schema=self.schema)


def _counts(rows: list[tuple], seen_of) -> tuple[str, dict, int, set]:
    """Tokens, fault counts, illegal neighbours and turns of a run of (turn, role, text, seen) rows."""
    tokens, faults, illegal, turns, last = [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, set(), None
    for turn, role, text in rows:
        t, fault = token(role, text, seen_of(role, text))
        tokens.append(t)
        faults[fault] += 1
        if turn is not None:
            turns.add(turn)
        if last is not None and last + initial(role) not in LEGAL:
            illegal += 1
        last = initial(role)
    return "".join(tokens), faults, illegal, turns


def _repair_whole(schema: pa.Schema, keep_rows: bool):
    def run(batches):
        out = _Out(schema)
        stream = _stream(batches, ("conv_id", "turn", "role", "text", "present"))
        for conv, group in _groups(stream):
            rows = [(turn, role, text) for _, turn, role, text, present in group if present]
            seen: set = set()

            def seen_of(role, text):
                known = (role, text) in seen
                seen.add((role, text))
                return known

            tokens, faults, illegal, turns = _counts(rows, seen_of)
            cost, audit = repair(tokens)
            fixed = list(apply_audit(audit, ((r, t) for _, r, t in rows)))
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            row = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                   _digest(fixed)[0].hexdigest())
            yield from out.add(*row, *([[{"role": r, "text": t} for r, t in fixed]] if keep_rows else []))
        yield out.flush()
    return run


def _schemas(conv: T.DataType, ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    st = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(ddl).fields])
    return st, to_arrow_schema(st)


def repair_conversations(rows: DataFrame, piece: int = PIECE, keep_rows: bool = False,
                         present: str | None = None) -> DataFrame:
    """One row per ``conv_id``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with
    ``keep_rows`` also ``repaired`` (array of role and text; a conversation of over ``piece`` rows is then an error)."""
    rows = prepared(rows, present)
    conv = rows.schema["conv_id"].dataType
    big = checkpointed(rows.groupBy("conv_id").count().where(F.col("count") > piece).select("conv_id"))
    none_big = big.isEmpty()
    if none_big:
        small = rows
    else:
        mark = small_side(big.withColumn("_big", F.lit(True)), 64)
        marked = rows.join(mark.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")),
                           "left").drop("_conv")
        small = marked.where(F.col("_big").isNull()).drop("_big")
    ddl = REPORT + (", repaired array<struct<role:string,text:string>>" if keep_rows else "")
    st, arrow = _schemas(conv, ddl)
    order = ["conv_id", "turn", "role", "text"]
    done = small.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair_whole(arrow, keep_rows), st)
    if none_big:
        return done
    if keep_rows:
        raise ValueError("a conversation has more rows than one piece: its repaired rows are not kept as one value")
    pieces = cut_pieces(marked.where(F.col("_big")).drop("_big"), piece)
    return done.unionByName(_large_report(pieces, conv))


# Conversations of many rows

PIECE_DDL = ("pid long, pno long, n long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, "
             "turns long, first_turn long, first string, last string, "
             "paths array<struct<a:int,b:int,cost:long,audit:string>>, roles array<string>, texts array<string>")


def _cut(schema: pa.Schema, size: int):
    def run(batches):
        from itertools import islice
        from pyspark import TaskContext
        pid, out = TaskContext.get().partitionId(), _Out(schema, 16)
        stream = _stream(batches, ("conv_id", "turn", "role", "text", "seen"))
        pno = 0
        for conv, group in _groups(stream):
            while part := list(islice(group, size)):
                flags = iter([p[4] for p in part])
                rows = [p[1:4] for p in part]
                tokens, faults, illegal, turns = _counts(rows, lambda role, text: next(flags))
                paths = [dict(a=a, b=b, cost=c, audit=x) for a, b, c, x in solve_piece(Rows(tokens))]
                yield from out.add(conv, pid, pno, len(rows), faults["blank"], faults["duplicate"], faults["truncated"],
                                   illegal, min(turns, default=None), max(turns, default=None), len(turns),
                                   rows[0][0], initial(rows[0][1]), initial(rows[-1][1]), paths,
                                   [r for _, r, _ in rows], [t for _, _, t in rows])
                pno += 1
        yield out.flush()
    return run


def cut_pieces(rows: DataFrame, size: int) -> DataFrame:
    """The rows of long conversations in pieces of at most ``size``, each solved between all states.  The first of equal
    (role, text) rows is found by aggregation, so that no conversation meets in one task."""
    conv = rows.schema["conv_id"].dataType
    rows = checkpointed(rows.where("present").withColumn("_row", F.monotonically_increasing_id()))
    key = ["conv_id", "role", F.md5("text").alias("_text")]
    first = (rows.groupBy(*key).agg(F.min(F.struct("turn", "_row")).alias("_first"))
             .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), "_text", F.col("_first._row").alias("_f")))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.md5("text") == F.col("_text"))
    rows = rows.join(first, same).select("conv_id", "turn", "role", "text", "_row",
                                         (F.col("_row") != F.col("_f")).alias("seen"))
    order = ["conv_id", "turn", "role", "text", "seen", "_row"]
    st, arrow = _schemas(conv, PIECE_DDL)
    cut = (rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
           .mapInArrow(_cut(arrow, size), st))
    return checkpointed(cut)


def _join_pieces(schema: pa.Schema):
    def run(batches):
        out = _Out(schema, 16)
        for key, group in _groups(((c, no), paths) for c, no, paths in _stream(batches, ("conv_id", "up", "paths"))):
            parts = [[(p["a"], p["b"], p["cost"], p["audit"]) for p in paths] for _, paths in group]
            paths = [dict(a=a, b=b, cost=c, audit=x) for a, b, c, x in solve_piece(Pieces(parts))]
            yield from out.add(key[0], key[1], paths)
        yield out.flush()
    return run


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with ``no``, their place in the conversation: pieces before in the same task, plus the tasks before."""
    per = pieces.groupBy("conv_id", "pid").agg(F.count("*").alias("k"), F.min("pno").alias("p0"))
    from pyspark.sql import Window
    before = F.coalesce(F.sum("k").over(Window.partitionBy("conv_id").orderBy("pid")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = per.select(F.col("conv_id").alias("_c"), F.col("pid").alias("_p"), (before - F.col("p0")).alias("_off"))
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pid") == F.col("_p"))
    return pieces.join(off, on).withColumn("no", F.col("pno") + F.col("_off")).drop("_c", "_p", "_off")


def _large_report(pieces: DataFrame, conv: T.DataType) -> DataFrame:
    pieces = checkpointed(_numbered(pieces))
    st, arrow = _schemas(conv, "up long, paths array<struct<a:int,b:int,cost:long,audit:string>>")
    level = pieces.select("conv_id", F.col("no").alias("up"), "paths")
    most = pieces.agg(F.max("no")).first()[0]
    while most:  # log_FAN(pieces) rounds
        level = level.withColumn("_no", F.col("up")).withColumn("up", F.floor(F.col("up") / FAN))
        level = checkpointed(level.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "_no")
                             .mapInArrow(_join_pieces(arrow), st))
        most //= FAN
    end = F.filter("paths", lambda p: (p["a"] == START) & p["b"].isin(START, DONE))
    best = F.array_min(F.transform(end, lambda p: F.struct(p["cost"], p["audit"])))
    won = level.select("conv_id", best.alias("w")).select("conv_id", F.col("w.cost").alias("cost"),
                                                          F.col("w.audit").alias("audit"))
    ends = pieces.select("conv_id", "no", "first", "last")
    nxt = ends.select(F.col("conv_id").alias("_c"), (F.col("no") - 1).alias("_n"), F.col("first").alias("_next"))
    seams = (ends.join(nxt, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("no") == F.col("_n")))
             .groupBy("conv_id").agg(F.count_if(~F.concat("last", "_next").isin(*LEGAL)).alias("seam")))
    # turns are in order, so a piece counts its own distinct ones, less the one it shares with the piece before
    prev = pieces.select(F.col("conv_id").alias("_c"), (F.col("no") + 1).alias("_n"), F.col("hi").alias("_hi"))
    shared = F.when(F.col("lo") == F.col("_hi"), 1).otherwise(0)
    sums = (pieces.join(prev, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("no") == F.col("_n")), "left")
            .groupBy("conv_id").agg(
                F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum(F.col("turns") - shared), F.lit(0)).alias("gaps"),
                *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))))
    for side in (seams, won):
        side = side.withColumnRenamed("conv_id", "_c")
        sums = sums.join(side, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    sums = sums.withColumn("illegal", F.col("illegal") + F.coalesce("seam", F.lit(0))).drop("seam")
    sums = checkpointed(sums)
    digests = _digests(pieces, sums, conv).withColumnRenamed("conv_id", "_c")
    out = sums.join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out.select("conv_id", *(F.col(c.split()[0]).cast(c.split()[1]) for c in REPORT.split(", ")))


def _fold_digest(schema: pa.Schema):
    def run(batches):
        out = _Out(schema, 16)
        for conv, group in _groups(_stream(batches, ("conv_id", "no", "audit", "roles", "texts"))):
            group = iter(group)
            audit = next(group)[2]
            pairs = (pair for _, _, _, roles, texts in group for pair in zip(roles, texts))
            yield from out.add(conv, _digest(apply_audit(audit, pairs))[0].hexdigest())
        yield out.flush()
    return run


def _digests(pieces: DataFrame, sums: DataFrame, conv: T.DataType) -> DataFrame:
    """The digest of each long conversation: its pieces streamed in order behind its audit, never held together."""
    st, arrow = _schemas(conv, "repaired_sha256 string")
    none = F.lit(None).cast("array<string>")
    lines = pieces.select("conv_id", "no", F.lit("").alias("audit"), "roles", "texts").unionByName(
        sums.select("conv_id", F.lit(-1).cast("bigint").alias("no"), "audit", none.alias("roles"), none.alias("texts")))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(_fold_digest(arrow), st)


def repaired_rows(rows: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, position, role, text of the repaired conversations; all of at most ``PIECE`` rows."""
    fixed = repair_conversations(rows, keep_rows=True, present=present)
    return fixed.select("conv_id", F.posexplode("repaired").alias("position", "r")).select(
        "conv_id", "position", "r.role", "r.text")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations damaged by the CRC of ``conv_id:turn`` modulo 20: 0 drops the row (``present`` false), 1 empties its
    text, 2 takes out its sentence marks, 3 repeats it, 4 makes its role user; other rows stay.  NULLs are one space."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(k == 4, "user").otherwise(blank("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("_k"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("_k") != 0).alias("present"),
                      F.explode(copies).alias("_copy")).drop("_copy")
