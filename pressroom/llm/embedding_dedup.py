"""Embedding near-duplicates by an inverted multi-index: cosine of at least ``threshold`` between whole vectors.

Exact copies become one vector with a number of copies.  Each half of a unit vector has a codebook of its own (k-means on
a bounded sample, ``SAMPLE``); the product of the two is a grid of cells.  A vector lives in the cell of its nearest
centres.  A multi-sequence traversal visits cells for it in the order of the summed half distances, as far as the slack
that covers the target recall: the slack is the quantile of what partners at exactly the threshold (the farthest that may
link), drawn around sampled vectors, would need.  A pair in different cells is looked for in one direction only, by the
vector of the lower cell, so that no pair is met twice.

Verification: what travels to a cell is an 8-bit code with its exact rounding error, about a third of a vector.  Bounds on
the cosine from codes and errors decide nearly all pairs; pairs they leave open are decided on the vectors themselves in
double precision, in a second, small shuffle.  Counts and a spanning forest per block leave a task, never pairs.  Cells of
over ``BLOCK`` vectors are grids of blocks, so a cell with a third of all vectors is shared out, and arriving vectors are
streamed past a block, never collected.

Defined results: NULL, empty, zero and not wholly finite vectors link with nothing and are their own component; vectors of
different lengths don't link; repeated ids are vectors of their own; a NULL id stays NULL and counts as a link, but never
names a component with other ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.functions.vectors import distances, kmeans, units, usable
from pressroom.llm.common import checkpointed, small_side
from pressroom.operators.components import connected_components
from pressroom.session import scratch_path

THRESHOLD = 0.9
#: Share of the pairs at exactly the threshold whose cell is visited (closer pairs fare better).
RECALL = 0.97
#: Vectors the codebooks are fitted on, and those the slack is measured with.
SAMPLE, PROBE_SAMPLE = 16_384, 2_000
#: Vectors a cell should hold on average, the most centres of a codebook, and the vectors of a block.
CELL, MOST_CENTRES, BLOCK = 200, 256, 2048


class Grid(NamedTuple):
    """Codebooks of the two halves of the first ``width`` components, and the slack of the traversal."""
    width: int
    left: np.ndarray
    right: np.ndarray
    slack: float

    def halves(self, x: np.ndarray):
        """Squared distances of unit rows to the centres of both halves; shorter vectors are filled up with zeros."""
        x = x[:, :self.width]
        if x.shape[1] < self.width:
            x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        h = self.width // 2
        return distances(x[:, :h], self.left), distances(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)


def multi_sequence(a: np.ndarray, b: np.ndarray, slack: float):
    """Cells (i, j) in the order of a[i] + b[j], as long as that is at most ``slack`` above the least."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    limit = a[0] + b[0] + slack
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        d, i, j = heappop(heap)
        if d > limit:
            return
        yield ia[i], ib[j]
        if j + 1 < len(b):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # a new row of the grid starts where its first cell is due
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Grid:
    """Codebooks for ``n`` vectors from a sample of unit rows, and the slack that covers ``recall`` of partners at
    exactly ``threshold``."""
    width = sample.shape[1]
    k = int(np.clip(round((n / CELL) ** 0.5), 1, MOST_CENTRES))
    h = width // 2
    left = kmeans(sample[:, :h], k) if h else np.zeros((1, 0))
    grid = Grid(width, left, kmeans(sample[:, h:], k), 0.0)
    x = sample[:PROBE_SAMPLE]
    noise = np.random.default_rng(17).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.sqrt((noise * noise).sum(1, keepdims=True))
    y = threshold * x + (1 - threshold ** 2) ** 0.5 * noise / np.where(size > 0, size, 1)
    a, b = grid.halves(x)
    ya, yb = grid.halves(y)
    row = np.arange(len(x))
    need = a[row, ya.argmin(1)] - a.min(1) + b[row, yb.argmin(1)] - b.min(1)
    return grid._replace(slack=float(np.quantile(need, recall)))


# ---------------------------------------------------------------------------------------------- codes and bounds

class Codes(NamedTuple):
    """Unit rows as 8-bit codes: x = scale * code + rest, |rest| = error."""
    code: np.ndarray
    scale: np.ndarray
    error: np.ndarray

    def take(self, at) -> Codes:
        return Codes(self.code[at], self.scale[at], self.error[at])


def encode(x: np.ndarray) -> Codes:
    scale = (np.abs(x).max(1) / 127).astype(np.float32).astype(np.float64)
    scale = np.where(scale > 0, scale, 1)
    code = np.clip(np.rint(x / scale[:, None]), -127, 127)
    rest = x - code * scale[:, None]
    # rounded up, so that the bound holds for the stored 32-bit number
    error = np.nextafter((np.sqrt((rest * rest).sum(1)) + 1e-12).astype(np.float32), np.float32(np.inf))
    return Codes(code.astype(np.int8), scale, error.astype(np.float64))


def decide(p: Codes, q: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(surely linked, open) for all rows of ``p`` x rows of ``q``; depends on each pair alone."""
    kind = np.float32 if p.code.shape[1] <= 1000 else np.float64  # sums of products of codes stay exact
    dot = (p.code.astype(kind) @ q.code.astype(kind).T) * p.scale[:, None] * q.scale[None, :]
    slack = p.error[:, None] + (1 + p.error[:, None]) * q.error[None, :] + 1e-9
    sure = dot - slack >= threshold
    return sure, (dot + slack >= threshold) & ~sure


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether unit rows x[i] and y[j] have at least the threshold as their product, in double precision."""
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = x[i[lo:lo + (1 << 14)]], y[j[lo:lo + (1 << 14)]]
        out[lo:lo + len(a)] = (a * b).sum(1) >= threshold
    return out


def forest(linked: np.ndarray):
    """Edges (row, column) of a spanning forest of a bipartite graph given as a matrix of links."""
    rows_left, cols_left = linked.any(1), linked.any(0)
    while rows_left.any():
        front = np.array([int(rows_left.argmax())])
        rows_left[front] = False
        while len(front):
            part = linked[front]
            new = np.flatnonzero(part.any(0) & cols_left)
            if not len(new):
                break
            cols_left[new] = False
            yield front[part[:, new].argmax(0)], new
            back = linked[:, new]
            front = np.flatnonzero(back.any(1) & rows_left)
            rows_left[front] = False
            if len(front):
                yield front, new[back[front].argmax(1)]


# ---------------------------------------------------------------------------------------------- Spark side

def vector_form(df: DataFrame, vec_col: str) -> str:
    """How components travel: 32-bit if the column has such, 64-bit otherwise; units are taken in double precision."""
    kind = df.schema[vec_col].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{vec_col} must be an array of numbers")
    return "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (digest of the unit vector), v (the vector as bytes), d (components) of every row; key, v and d are NULL
    where the vector can't be used."""
    form = vector_form(df, vec_col)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.when(usable(vec_col), F.col(vec_col).cast("array<double>")).alias("v"))

    def run(batches):
        for batch in batches:
            vs = batch.column(1)
            key, raw, size = [], [], []
            starts, flat = vs.offsets.to_numpy(), vs.values.to_numpy(zero_copy_only=False)
            valid = vs.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(vs)):
                if not valid[i]:
                    key.append(None), raw.append(None), size.append(None)
                    continue
                x = flat[starts[i]:starts[i + 1]] + 0.0
                key.append(hashlib.blake2b((units(x[None, :]) + 0.0).tobytes(), digest_size=16).digest())
                raw.append(x.astype(form).tobytes())
                size.append(len(x))
            yield pa.record_batch([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary()),
                                   pa.array(size, pa.int32())], names=["id", "key", "v", "d"])

    return rows.mapInArrow(run, "id long, key binary, v binary, d int")


def _matrix(values, d: int, form: str) -> np.ndarray:
    """Unit rows in double precision."""
    return units(np.frombuffer(b"".join(values), form).reshape(-1, d)) if values else np.zeros((0, d))


def _record(codes: Codes, copies) -> list[bytes]:
    head = np.stack([codes.scale, codes.error], 1).astype("<f4")
    return [int(n).to_bytes(8, "little") + head[i].tobytes() + codes.code[i].tobytes() for i, n in enumerate(copies)]


def _read(records: list[bytes]) -> tuple[Codes, np.ndarray]:
    raw = np.frombuffer(b"".join(records), np.uint8).reshape(len(records), -1)
    head = np.ascontiguousarray(raw[:, 8:16]).view("<f4").astype(np.float64)
    return (Codes(np.ascontiguousarray(raw[:, 16:]).view(np.int8), head[:, 0], head[:, 1]),
            np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0].astype(np.int64))


def _visits(grid: Grid, form: str, whole: bool):
    """node, d, cell, home, rec: each vector at home, and (``whole``) at the higher cells it visits."""
    k = len(grid.right)

    def run(batches):
        for batch in batches:
            node, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            copies, raw = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            out = ([], [], [], [], [])
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x = _matrix([raw[i] for i in at], int(size), form)
                a, b = grid.halves(x)
                own = a.argmin(1) * k + b.argmin(1)
                recs = _record(encode(x), copies[at]) if whole else [None] * len(at)
                for r, i in enumerate(at):
                    cells = [int(own[r])]
                    if whole:
                        cells += [c for p, q in multi_sequence(a[r], b[r], grid.slack) if (c := p * k + q) > own[r]]
                    for n, c in enumerate(cells):
                        for col, v in zip(out, (node[i], size, c, n == 0, recs[r])):
                            col.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)],
                                  names=["node", "d", "cell", "home", "rec"])
    return run


FOUND = "kind string, node long, other long, n long, d int, cell int, block int, home boolean"


class _Found:
    def __init__(self):
        self.cols: list[list] = [[] for _ in range(8)]

    def add(self, kind, nodes, others=None, n=None, key=(None,) * 3, home=None):
        m = len(nodes)
        fill = lambda v: list(v) if v is not None else [None] * m
        for col, v in zip(self.cols, ([kind] * m, nodes, fill(others), fill(n), [key[0]] * m, [key[1]] * m,
                                      [key[2]] * m, [home] * m)):
            col.extend(v)

    def batch(self):
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        names = [c.split()[0] for c in FOUND.split(", ")]
        out = pa.record_batch([pa.array(c, t) for c, t in zip(self.cols, types)], names=names)
        self.cols = [[] for _ in range(8)]
        return out


def _tell(out: _Found, linked, p_nodes, p_copies, q_nodes, q_copies):
    """Counts of both sides and a spanning forest for a matrix of links."""
    r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if len(r):
        out.add("links", p_nodes[r].tolist(), n=(linked[r] @ q_copies).tolist())
        out.add("links", q_nodes[c].tolist(), n=(p_copies @ linked[:, c]).tolist())
        for i, j in forest(linked):
            out.add("edge", p_nodes[i].tolist(), q_nodes[j].tolist())


def _meet(threshold: float, form: str | None = None):
    """One block of a cell after the other: its home vectors against each other and against those that visit.  By codes,
    pairs left open name their vectors; with a ``form`` of vectors those pairs are decided."""
    by_vector = form is not None

    def parts(group, size):
        """(home rows, iterator over batches of visitors); home rows come first and are at most about ``BLOCK``."""
        it = iter(group)
        home, first = [], None
        for r in it:
            if not r[3]:
                first = r
                break
            home.append(r)

        def visitors():
            nonlocal first
            now = [first] if first is not None else []
            for r in it:
                now.append(r)
                if len(now) == size:
                    yield now
                    now = []
            if now:
                yield now
        return home, visitors()

    def load(rows):
        node = np.array([r[4] for r in rows], np.int64)
        if not by_vector:
            codes, copies = _read([r[5] for r in rows])
            return node, copies, codes, None
        x = _matrix([r[5] for r in rows], rows[0][0], form)
        return node, np.array([r[6] for r in rows], np.int64), encode(x), x

    def judge(out, p, q, key, same):
        p_node, p_copies, p_codes, px = p
        q_node, q_copies, q_codes, qx = q
        sure, unsure = decide(p_codes, q_codes, threshold)
        if same:
            upper = np.triu(np.ones(sure.shape, bool), 1)
            sure, unsure = sure & upper, unsure & upper
        if not by_vector:
            out.add("open", p_node[unsure.any(1)].tolist(), key=key, home=True)
            out.add("open", q_node[unsure.any(0)].tolist(), key=key, home=same)
            _tell(out, sure, p_node, p_copies, q_node, q_copies)
            return
        i, j = np.nonzero(unsure)
        linked = np.zeros(unsure.shape, bool)
        ok = exact(px, qx, i, j, threshold)
        linked[i[ok], j[ok]] = True
        _tell(out, linked, p_node, p_copies, q_node, q_copies)

    def run(batches):
        def stream():
            names = ("d", "cell", "block", "home", "node", "rec") + (("copies",) if by_vector else ())
            for batch in batches:
                yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))

        out = _Found()
        for key, group in groupby(stream(), key=lambda r: r[:3]):
            home, visitors = parts(group, BLOCK)
            if not home:
                for _ in visitors:
                    pass
                continue
            p = load(home)
            judge(out, p, p, key, True)
            for rows in visitors:
                judge(out, p, load(rows), key, False)
                if len(out.cols[0]) > 50_000:
                    yield out.batch()
        yield out.batch()
    return run


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other rows linked directly), component_id (smallest id reachable),
    kept."""
    spark = df.sparkSession
    rows, form = vectors(df, id_col, vec_col), vector_form(df, vec_col)
    path = scratch_path(spark, "embeddings")
    (rows.where("key IS NOT NULL").groupBy("key", "d").agg(F.min("id").alias("id"), F.count("*").alias("copies"),
                                                            F.min("v").alias("v"))
     .withColumn("node", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path))
    reps = spark.read.parquet(path)
    sizes = reps.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width, n = int(sizes[0].d), reps.count()
    sample = [r.v for r in reps.where(F.col("d") == width).select("key", "v").orderBy("key").limit(SAMPLE).collect()]
    grid = fit(_matrix(sample, width, form), n, threshold, recall)

    vecs = reps.select("node", "d", "copies", "v")
    visit = "node long, d int, cell int, home boolean, rec binary"
    large = (vecs.mapInArrow(_visits(grid, form, False), visit).groupBy("d", "cell").count().where(F.col("count") > BLOCK)
             .select("d", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    large = small_side(checkpointed(large), 32)
    placed = vecs.mapInArrow(_visits(grid, form, True), visit).join(large, ["d", "cell"], "left")
    last = F.coalesce("blocks", F.lit(1)) - 1
    own = F.pmod(F.xxhash64("node"), last + 1).cast("int")
    # a home vector also visits the later blocks of its cell; a visitor of a cell visits all its blocks
    placed = placed.select("d", "cell", "home", "node", "rec", own.alias("own"), F.explode(F.sequence(
        F.when(F.col("home"), own).otherwise(0), last)).alias("block"))
    placed = placed.select("d", "cell", "block", (F.col("home") & (F.col("block") == F.col("own"))).alias("home"),
                           "node", "rec")
    key = ["d", "cell", "block"]
    order = [*key, F.desc("home"), "node"]
    found = checkpointed(placed.repartition(*key).sortWithinPartitions(*order).mapInArrow(_meet(threshold), FOUND))
    unsure = found.where("kind = 'open'").groupBy(*key, "node").agg(F.max("home").alias("home"))
    second = (unsure.join(reps.select("node", "copies", F.col("v").alias("rec")), "node")
              .repartition(*key).sortWithinPartitions(*order).mapInArrow(_meet(threshold, form), FOUND))
    found = found.where("kind <> 'open'").unionByName(checkpointed(second))

    counts = found.where("kind = 'links'").groupBy("node").agg(F.sum("n").alias("n"))
    star = checkpointed(connected_components(found.where("kind = 'edge'"), "node", "other"))
    reps = reps.drop("v", "d")
    roots = star.join(reps.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("component"))
    linked = star.join(roots, "root").select("node", "component")
    each = (reps.join(counts, "node", "left").join(linked, "node", "left")
            .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))
    # a plain table, so that AQE can split the rows of a vector with very many copies
    each = checkpointed(each)
    usable_rows = rows.where("key IS NOT NULL").select("id", "key").join(each, "key").select("id", "n_links", "component_id")
    rest = rows.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable_rows.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                                F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
