"""Semantic similarity: the nearest rows by cosine, from inverted lists with product-quantised codes and exact re-ranking.

Vectors are scaled to length 1.  A coarse codebook (k-means on a bounded sample) deals them to lists; what is left after
subtracting the centre is coded with one byte for each of ``PARTS`` slices.  A query looks into the lists of its nearest
centres; how many, is measured: on the sample the wanted share of true neighbours must lie in them.  Inside a list the
codes give approximate distances (a table a query and slice), the best ``RERANK`` x k are compared in double precision, and
only the best k leave the task.

Members and queries meet by (list, block): a list of over ``BLOCK`` members is dealt to several tasks, queries are streamed
past a block.  Nothing is compared outside the lists looked into, and no pair but a query's best leaves a task.

NULL, empty, zero and not wholly finite vectors, and those of another length than most, are neither found nor answered; rows
without an id are not found; a row is not its own neighbour (rows of the same id are); ties go to the smaller id.
"""

from __future__ import annotations

from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.vectors import distances, kmeans, nearest, units, usable
from pressroom.session import checkpoint_dir

#: Vectors the codebooks are fitted on; queries of the sample that the number of lists is measured with.
SAMPLE, MEASURED = 16_384, 400
PARTS, CODES, RERANK, BLOCK, MOST_LISTS = 8, 256, 8, 4096, 4096
RECALL = 0.96


class Codebooks(NamedTuple):
    centres: np.ndarray
    slices: list[slice]
    parts: list[np.ndarray]
    probes: int

    def code(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centres[own]
        return np.stack([nearest(rest[:, s], p) for s, p in zip(self.slices, self.parts)], 1).astype(np.uint8)

    def approximate(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded members of one list."""
        rest = queries - self.centres[centre]
        out = np.zeros((len(queries), len(codes)))
        for j, (s, p) in enumerate(zip(self.slices, self.parts)):
            out += distances(rest[:, s], p)[:, codes[:, j]]
        return out


def measure_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists a query must look into so that they hold ``recall`` of its true k neighbours, on the sample."""
    queries = sample[:MEASURED]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(distances(queries, centres), axis=1, kind="stable"), axis=1)
    need = np.sort(np.take_along_axis(rank, nearest(sample, centres)[best], 1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def fit(sample: np.ndarray, n: int, k: int = 10, recall: float = RECALL) -> Codebooks:
    centres = kmeans(sample, int(np.clip(round(n ** 0.5), 1, MOST_LISTS)))
    d = sample.shape[1]
    cuts = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
    slices = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    rest = sample - centres[nearest(sample, centres)]
    parts = [kmeans(rest[:, s], CODES, 6) for s in slices]
    return Codebooks(centres, slices, parts, measure_probes(sample, centres, k, recall))


def _units(batch_column, d: int) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    return units(flat.reshape(-1, d)) if len(flat) else np.zeros((0, d))


def _place(books: Codebooks, d: int):
    """Batches of (self, v, query, id) to (list, query, self, id, v, code): members once, queries for each list they look
    into."""
    def run(batches):
        for batch in batches:
            x, is_query = _units(batch.column(1), d), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            far = distances(x, books.centres)
            member = np.flatnonzero(~is_query)
            own = far[member].argmin(1)
            ask = np.flatnonzero(is_query)
            probes = min(books.probes, len(books.centres))
            into = np.argsort(far[ask], axis=1, kind="stable")[:, :probes]
            row = np.concatenate([member, np.repeat(ask, probes)])
            raw = [r.tobytes() for r in x.astype("<f8")]
            codes = [c.tobytes() for c in books.code(x[member], own)] + [None] * (len(ask) * probes)
            yield pa.record_batch([
                pa.array(np.concatenate([own, into.ravel()]).astype(np.int32)), pa.array(is_query[row]),
                batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)),
                pa.array([raw[i] for i in row], pa.binary()), pa.array(codes, pa.binary())],
                names=["list", "query", "self", "id", "v", "code"])
    return run


def _search(books: Codebooks, d: int, k: int):
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist()
                                 for c in ("list", "block", "query", "id", "v", "code", "self")))

        for (centre, _), group in groupby(rows(), key=lambda r: r[:2]):
            members, asking = [], []

            def answer():
                ids = np.array([r[3] for r in members], np.int64)
                own = np.array([r[6] for r in members], np.int64)
                x = np.frombuffer(b"".join(r[4] for r in members), "<f8").reshape(-1, d)
                codes = np.frombuffer(b"".join(r[5] for r in members), np.uint8).reshape(len(members), -1)
                q = np.frombuffer(b"".join(r[4] for r in asking), "<f8").reshape(-1, d)
                near = books.approximate(q, centre, codes)
                for i, r in enumerate(asking):
                    near[i, own == r[6]] = np.inf  # not its own neighbour
                keep = min(RERANK * k, len(members))
                best = np.argpartition(near, keep - 1, axis=1)[:, :keep]
                out = [], [], [], []
                for i, r in enumerate(asking):
                    at = best[i][np.isfinite(near[i, best[i]])]
                    cosine = (x[at] * q[i]).sum(1)
                    at, cosine = (a[np.lexsort((ids[at], -cosine))[:k]] for a in (at, cosine))
                    for col, v in zip(out, ([r[6]] * len(at), [r[3]] * len(at), ids[at].tolist(), cosine.tolist())):
                        col.extend(v)
                return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                        pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())],
                                       names=["self", "id", "other", "cosine"])

            for r in group:  # members come first; a block is bounded, queries are answered as they come
                if not r[2]:
                    members.append(r)
                    continue
                asking.append(r)
                if len(asking) == 256:
                    if members:
                        yield answer()
                    asking.clear()
            if asking and members:
                yield answer()
    return run


def nearest_rows(df: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
                 recall: float = RECALL) -> DataFrame:
    """id, rank, other, cosine: the ``k`` nearest other rows of every row for which the Column ``queries`` holds."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                     F.coalesce(queries, F.lit(False)).alias("asks")).where(usable("v"))
    rows = rows.withColumn("self", F.monotonically_increasing_id()).checkpoint()
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "id long, rank int, other long, cosine double"
    if not sizes:
        return spark.createDataFrame([], out)
    d, n = sizes[0].d, sizes[0]["count"]
    rows = rows.where(F.size("v") == d)
    # the hash decides the order, so the sample does not hang on partitions
    sample = [r.v for r in rows.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
    books = fit(units(np.array(sample)), n, k, recall)
    both = rows.where("id IS NOT NULL").select("self", "v", F.lit(False).alias("query"), "id").unionByName(
        rows.where("asks").select("self", "v", F.lit(True).alias("query"), "id"))
    placed = both.mapInArrow(_place(books, d), "list int, query boolean, self long, id long, v binary, code binary")
    placed = placed.checkpoint()
    blocks = placed.where("NOT query").groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    last = F.col("blocks") - 1  # at most MOST_LISTS rows
    own = F.pmod(F.xxhash64("self"), F.col("blocks")).cast("int")
    dealt = placed.join(F.broadcast(blocks), "list").withColumn("block", F.explode(
        F.when(F.col("query"), F.sequence(F.lit(0), last)).otherwise(F.array(own)))).drop("blocks")
    found = (dealt.repartition("list", "block").sortWithinPartitions("list", "block", "query")
             .mapInArrow(_search(books, d, k), "self long, id long, other long, cosine double"))
    best = Window.partitionBy("self").orderBy(F.desc("cosine"), "other")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("id", "rank", "other", "cosine"))
