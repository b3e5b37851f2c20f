"""SimHash near-duplicates by the general pigeonhole principle.

A text's fingerprint has a bit set when more than half of its word shingles' XXH64 hashes have it set.  Two
fingerprints link when at most ``distance`` of their 64 bits differ; documents are grouped by links, transitively.

Candidates.  The 64 bits are split into m partitions of correlated bits, partition i with a threshold T_i >= -1 and
the T_i adding up to ``distance - m + 1``: fingerprints within ``distance`` are then within T_i in some partition i
(-1: the partition is not searched).  ``plan_search`` estimates, from bit and bit-pair counts over all distinct
fingerprints and the sizes of all buckets, how many candidate pairs each partition yields at each threshold, and a
dynamic programme allots the thresholds; the m with the least estimated work is taken.  Each fingerprint is indexed
under its bits in every searched partition and probes all values within T_i.  Candidates of a bucket are verified on
the full 64 bits.

Scale.  Copies collapse to one row per distinct fingerprint first (partial aggregation).  A bucket never makes all
its pairs as rows: its task compares bits block by block and emits a spanning forest of its links.  Buckets over
``BLOCK`` members are cut into blocks and dealt out as a grid of block pairs, so no task gets an unbounded bucket and
no pair is missed.  Links are joined to groups by the shared star-contraction helper on distinct fingerprints.

Defined results: a NULL text is an empty one; no words gives fingerprint 0, linked like any other; repeated rows and
repeated ids each get their row; a row with a NULL id gets a component by its text (the smallest id there, NULL if
there is none); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import checkpointed, fresh, small_side
from pressroom.operators.components import connected_components

SEED = 42
BITS = 64
#: Members of a bucket that one task compares with each other; larger buckets are dealt out in blocks of this size.
BLOCK = 16_384
#: What emitting and shuffling one row costs, in compared pairs (for choosing the number of partitions).
ROW_COST = 300
_CHUNK = 8_192


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text; the counts need constant memory beside the words."""
    ws = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(accumulate((len(w) + 1 for w in ws)))
    k = min(shingle, len(ws))
    n = len(ws) - k + 1
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(lo + _CHUNK, n)
        starts = [0, *ends[:hi - 1]][lo:] if lo == 0 else ends[lo - 1:hi - 1]
        digests = b"".join([xxhash.xxh64_digest(joined[s:e - 1], SEED)
                            for s, e in zip(starts, ends[lo + k - 1:hi + k - 1])])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:  # one text at a time is a Python string, never a whole batch
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))
    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per fingerprint; column b is bit b (b = 0: the lowest)."""
    return ((fps.view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _gather(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The value that the bits of ``part`` form."""
    u = fps.view(np.uint64)
    out = np.zeros(len(u), np.int64)
    for j, b in enumerate(part):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of rows with both bits set) over all distinct fingerprints."""
    def sums(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for pdf in batches:
            x = _bits(pdf["fp"].to_numpy(np.int64)).astype(np.float32)
            for lo in range(0, len(x), 65_536):
                total += (x[lo:lo + 65_536].T @ x[lo:lo + 65_536]).astype(np.int64)
            n += len(x)
        yield pd.DataFrame({"k": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})
    rows = (distinct.select("fp").mapInPandas(sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect())
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in rows:
        flat[k] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width, correlated bits together: each starts at the least balanced free bit
    and takes the free bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free = set(range(BITS))
    parts = []
    for i in range(m):
        size = (BITS - sum(map(len, parts))) // (m - i)
        part = [max(free, key=lambda b: (abs(p[b] - 0.5), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _distance_shares(p: np.ndarray) -> np.ndarray:
    """Share of pairs at each distance over bits that are set with chances ``p``, taken as independent."""
    out = np.ones(1)
    for q in 2 * p * (1 - p):
        out = np.append(out, 0) * (1 - q) + np.append(0, out) * q
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds T_i >= -1 with sum(T_i + 1) = ``total`` and the least sum of costs[i][T_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t1 in range(min(total - used, len(c) - 1) + 1):
                x = (cost + c[t1], [*ts, t1 - 1])
                if used + t1 not in step or x[0] < step[used + t1][0]:
                    step[used + t1] = x
        best = step
    return best[total]


def plan_search(distinct: DataFrame, distance: int):
    """(partitions as lists of bits, thresholds, buckets over BLOCK members as a frame (part, key, n))."""
    n, both = bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    tried = [group_bits(n, both, m) for m in range(2, distance + 2)] if distance else [[list(range(BITS))]]

    def keys(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for t, parts in enumerate(tried):
                for i, part in enumerate(parts):
                    yield pd.DataFrame({"t": t, "part": i, "key": _gather(fps, part)})
    sizes = checkpointed(distinct.select("fp").mapInPandas(keys, "t int, part int, key long")
                         .groupBy("t", "part", "key").agg(F.count(F.lit(1)).alias("n")))
    same = {(t, i): float(s) for t, i, s in sizes.groupBy("t", "part")
            .agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).collect()}
    found = None
    for t, parts in enumerate(tried):
        costs = []
        for i, part in enumerate(parts):
            shares = _distance_shares(p[part])
            at_zero = same.get((t, i), 0.0)
            row = [0.0]
            for r in range(min(distance, len(part)) + 1):
                pairs = min(at_zero * shares[:r + 1].sum() / max(shares[0], 1e-300), float(n) * n)
                row.append(pairs + n * ROW_COST * (1 + sum(comb(len(part), j) for j in range(1, r + 1))))
            costs.append(row)
        cost, ts = allot(costs, distance + 1)
        if found is None or cost < found[0]:
            found = (cost, t, ts)
    _, t, ts = found
    large = sizes.filter((F.col("t") == t) & (F.col("n") > BLOCK)).select("part", "key", "n")
    return tried[t], ts, large


def _forest(fps: np.ndarray, indexed: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) for the groups that links between indexed members and all members of a bucket make."""
    fps, first = np.unique(fps, return_index=True) if indexed.all() else (fps, None)
    indexed = np.ones(len(fps), bool) if first is not None else indexed
    left = np.flatnonzero(indexed)
    linked = np.zeros(len(fps), bool)
    step = max(1, 2_000_000 // max(len(fps), 1))
    for lo in range(0, len(left), step):
        rows = left[lo:lo + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= distance
        near &= fps[rows][:, None] != fps[None, :]
        linked[rows] |= near.any(axis=1)
        linked |= near.any(axis=0)
    rest = np.flatnonzero(linked)
    a, b = [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = fps[front[0]]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for x in front:
                other = rest if indexed[x] else rest[indexed[rest]]
                near = np.bitwise_count(fps[other] ^ fps[x]) <= distance
                if indexed[x]:
                    hit |= near
                else:
                    hit[indexed[rest]] |= near
            front, rest = rest[hit], rest[~hit]
            a.append(np.full(len(front), root))
            b.append(fps[front])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): edges that connect the same groups as all links within ``distance`` do (of a bucket's group, one edge
    from its root to each member)."""
    parts, ts, large = plan_search(distinct, distance)

    def probes(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for i, (part, t) in enumerate(zip(parts, ts)):
                if t < 0:
                    continue
                key = _gather(fps, part)
                for r in range(t + 1):
                    for flip in combinations(range(len(part)), r):
                        yield pd.DataFrame({"part": i, "key": key ^ sum(1 << j for j in flip), "indexed": r == 0,
                                            "fp": fps})
    rows = distinct.select("fp").mapInPandas(probes, "part int, key long, indexed boolean, fp long")
    # a large bucket becomes a grid of cells: indexed members by block along one side, all members along the other
    large = small_side(checkpointed(large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))), 40)
    rows = rows.join(large, ["part", "key"], "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda j: F.struct(block.alias("x"), j.alias("y"), F.col("indexed").alias("indexed")))
    down = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda j: F.struct(j.alias("x"), block.alias("y"), F.lit(False).alias("indexed")))
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("indexed").alias("indexed")))
    cells = F.when(F.col("blocks").isNull(), whole).when(F.col("indexed"), F.concat(across, down)).otherwise(down)
    rows = rows.select("part", "key", "fp", F.inline(cells))
    cell = ["part", "key", "x", "y"]

    def verify(batches):
        kept: list[pd.DataFrame] = []

        def solve(pdf):
            pdf = pdf.drop_duplicates()
            v = pdf[cell].to_numpy()
            cuts = np.flatnonzero((v[1:] != v[:-1]).any(axis=1)) + 1
            fps, ind = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["indexed"].to_numpy(bool)
            out_a, out_b = [], []
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(v))):
                if hi - lo > 1 and ind[lo:hi].any():
                    a, b = _forest(fps[lo:hi], ind[lo:hi], distance)
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)})

        for pdf in batches:  # sorted by cell: hold back the last cell, which may go on in the next batch
            if len(pdf):
                kept.append(pdf)
                last = tuple(pdf[cell].iloc[-1])
                if tuple(kept[0][cell].iloc[0]) != last:
                    pdf = pd.concat(kept)
                    ends = (pdf[cell] == last).all(axis=1).to_numpy()
                    kept = [pdf[ends]]
                    yield from solve(pdf[~ends])
        if kept:
            yield from solve(pd.concat(kept))

    return (rows.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(verify, "a long, b long")
            .filter("a <> b").distinct())


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; ``component_id``: the smallest id reachable over links."""
    own = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    groups = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = checkpointed(links(groups, distance))
    star = checkpointed(connected_components(edges).withColumnsRenamed({"node": "fp"}))
    roots = star.join(groups, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = star.join(roots, "root").select("fp", "component_id")
    groups = checkpointed(groups.join(linked, "fp", "left")
                          .select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    # the groups are now a plain table, so that AQE can split the rows of a hot fingerprint
    return own.join(groups, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group (all their columns).  Rows that repeat an id are one
    document: of them the one with the least (text hash) stays.  Rows with a NULL id stay."""
    found = checkpointed(simhash_components(docs, shingle, distance, id_col, text_col))
    gone = checkpointed(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    kept = docs.join(small_side(gone, 24), F.col(id_col) == F.col("gone_id"), "left_anti")
    again = found.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").filter("doc_id IS NOT NULL")
    if again.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        from pyspark.sql import Window
        rank, = fresh(kept, "same_id_rank")
        # rows without an id are not ranked, but must not meet in one task either
        w = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(text_col))).orderBy(
            F.xxhash64(text_col))
        kept = (kept.withColumn(rank, F.when(F.col(id_col).isNull(), 1).otherwise(F.row_number().over(w)))
                .filter(F.col(rank) == 1).drop(rank))
    return kept
