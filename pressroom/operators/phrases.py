"""Phrases: the most frequent runs of n words, exactly, and how strongly their words belong together.

Counting every n-gram of a large corpus shuffles about as many rows as there are words.  Two passes avoid it:

1. *Summaries.*  Every task keeps at most ``capacity`` counters over 64-bit hashes of its n-grams.  When there are more, the
   largest count left out is subtracted from all and noted as the task's error (the mergeable form of space-saving), so a
   counter is low by at most that error, and an n-gram without one is no more frequent than it.  Counters are added up by one
   shuffle of at most ``capacity`` rows a task.  With E the sum of errors and L the n-th largest sum, an n-gram of the
   top n has a sum of at least L - E.  While E is over L / 2 the capacity grows fourfold: with room for all, E is zero.
2. *Exact counts* of the survivors by their words, natively: semi-join on the hash, partial aggregation, so what is shuffled
   is at most survivors x tasks.  Survivors are at most 2 x n-grams / L.  They are broadcast only if counted to be at most
   ``BROADCAST_ROWS`` (8 bytes each), and joined by shuffle otherwise.

Two n-grams of one hash only raise a sum, so they can only make L too large; the exact n-th count then falls below L, and
pass 2 is repeated with that count for L.  The result is exact whatever the hashes.

Association of a pair of words is the log-likelihood ratio (Dunning) of its 2 x 2 table: pairs, pairs that begin with the
first word, pairs that end with the second, all pairs.

Words are those of the search index (lower case, letters and digits).  NULL, empty and shorter texts have no n-grams;
repeated rows count again; equal counts are ranked by the words; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.operators.search_index import words
from pressroom.session import scratch_path, spread

CAPACITY, GROWTH = 100_000, 4
BUFFER = 1_000_000            # hashes held by a task before they are folded into its summary
SLICE = 250_000               # hashes of a batch that are joined to runs at once
BROADCAST_ROWS = 2_000_000
TURN = 17                     # bits by which the hash so far is turned before the next word's is mixed in


class Summary:
    """At most ``capacity`` counters of hashes; each is low by at most ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None, error: int = 0) -> None:
        """Count hashes, or merge another summary's counters and error."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.error += error
        if len(both) > self.capacity:
            cut = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            total -= cut
            both, total = both[total > 0], total[total > 0]
            self.error += cut
        self.keys, self.counts = both, total


def joined(hashes: list[Column]) -> Column:
    """The hash of a run of words from the hashes of its words (as :func:`joined_runs` has it)."""
    out = hashes[0]
    for h in hashes[1:]:
        out = F.shiftleft(out, TURN).bitwiseOR(F.shiftrightunsigned(out, 64 - TURN)).bitwiseXOR(h)
    return out


def joined_runs(hashes: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n words in texts of these lengths, laid end to end."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64)
    words_of = hashes.view(np.uint64)
    out = words_of[:k]
    for j in range(1, n):
        out = (out << np.uint64(TURN) | out >> np.uint64(64 - TURN)) ^ words_of[j:j + k]
    text = np.repeat(np.arange(len(lengths)), lengths)
    return out[text[:k] == text[n - 1:]].view(np.int64)


def sliced_runs(hashes: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The same runs, at most ``SLICE`` at a time, so that what a task holds beside its batch does not grow with it."""
    ends = np.cumsum(lengths, dtype=np.int64)
    for a in range(0, len(hashes), SLICE):
        b = min(a + SLICE + n - 1, len(hashes))  # a run belongs to the slice it begins in
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        yield joined_runs(hashes[a:b], np.minimum(ends[lo:hi], b) - np.maximum(ends[lo:hi] - lengths[lo:hi], a), n)


def runs(texts: DataFrame, n: int) -> DataFrame:
    """h, w0 ... : a row for each run of n words, repeats included."""
    w = F.col("w")
    k = F.size(w) - F.lit(n - 1)
    names = [f"w{j}" for j in range(n)]
    zipped = F.arrays_zip(*[F.slice(w, F.lit(j + 1), k).alias(x) for j, x in enumerate(names)])
    cut = texts.select(words(F.col("text")).alias("w")).select(F.explode(F.when(k >= 1, zipped)).alias("r"))
    cut = cut.select(*[F.col("r")[x].alias(x) for x in names])
    return cut.withColumn("h", joined([F.xxhash64(x) for x in names]))


def summaries(hashes: DataFrame, capacity: int, n: int = 1) -> DataFrame:
    """(h, low, error) a task: its counters, and its error in one row whose h is NULL.  ``hashes``: one column, the hashes of
    each text's words; runs of n of them are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = Summary(capacity), [], 0
        for batch in batches:
            lists = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            for got in sliced_runs(flat, lengths, n):
                held.append(got)
                size += len(got)
                if size >= BUFFER:
                    kept.add(np.concatenate(held))
                    held, size = [], 0
        if held:
            kept.add(np.concatenate(held))
        for at in range(0, len(kept.keys), 10_000):
            keys, low = kept.keys[at:at + 10_000], kept.counts[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(low), pa.nulls(len(keys), pa.int64())],
                                             ["h", "low", "error"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([kept.error], pa.int64())],
                                         ["h", "low", "error"])
    return hashes.mapInArrow(run, "h long, low long, error long")


def _candidates(texts: DataFrame, n: int, top: int, capacity: int) -> tuple[DataFrame, int, int]:
    """Summed counters (h, low), the sum of errors E and the n-th largest sum L, with E at most L / 2."""
    spark = texts.sparkSession
    hashes = texts.select(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    while True:
        path = scratch_path(spark, "phrases")
        (summaries(hashes, capacity, n).groupBy("h").agg(F.sum("low").alias("low"), F.sum("error").alias("error"))
         .write.parquet(path))
        summed = spark.read.parquet(path)
        error = summed.where("h IS NULL").agg(F.sum("error")).first()[0] or 0
        summed = summed.where("h IS NOT NULL").select("h", "low")
        ranked = summed.orderBy(F.desc("low")).limit(top).agg(F.min("low"), F.count("*")).first()
        least = ranked[0] if ranked[1] == top else 0
        if 2 * error <= least or error == 0:
            return summed, error, least
        capacity *= GROWTH


def top_ngrams(texts: DataFrame, n: int, top: int, text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """n, rank, phrase, count: the ``top`` most frequent n-grams, exactly."""
    texts = spread(texts.select(F.col(text_col).alias("text")))
    spark = texts.sparkSession
    summed, error, least = _candidates(texts, n, top, capacity)
    while True:
        keep = summed.where(F.col("low") >= least - error).select("h")
        few = keep.count() <= BROADCAST_ROWS
        names = [f"w{j}" for j in range(n)]
        path = scratch_path(spark, "phrase-counts")
        (runs(texts, n).join(F.broadcast(keep) if few else keep, "h", "left_semi")
         .groupBy(*names).agg(F.count("*").alias("count"))
         .select(F.concat_ws(" ", *names).alias("phrase"), "count").orderBy(F.desc("count"), "phrase").limit(top).write.parquet(path))
        best = spark.read.parquet(path)
        got = best.agg(F.min("count"), F.count("*")).first()
        exact = got[0] if got[1] == top else 0
        if exact >= least or error == 0 and least == 0:
            break
        least = exact  # two n-grams of one hash had raised it
    # at most ``top`` rows
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "phrase"))
    return best.select(F.lit(n).alias("n"), rank.alias("rank"), "phrase", "count")


def log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """The log-likelihood ratio of a 2 x 2 table given by its corner, margins and total."""
    def term(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.ln(k * total / (row * column))).otherwise(F.lit(0.0))
    k, a, b = both.cast("double"), first.cast("double"), second.cast("double")
    return 2 * (term(k, a, b) + term(a - k, a, total - b) + term(b - k, total - a, b)
                + term(total - a - b + k, total - a, total - b))


def associations(texts: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """phrase, count, n_first, n_second, score of counted pairs of words (rows of :func:`top_ngrams` with n = 2).

    Margins are counted only for the words of ``pairs`` (few by the limit they come from, so the two joins of the small
    result are left to Spark); the rest of the corpus leaves a task as one number."""
    text = F.col(text_col)

    def sides(w: Column) -> Column:
        k = F.size(w) - 1
        mark = lambda side, a: F.transform(a, lambda x: F.struct(F.lit(side).alias("side"), x.alias("word")))
        return F.when(k >= 1, F.concat(mark(0, F.slice(w, F.lit(1), k)), mark(1, F.slice(w, F.lit(2), k))))

    at = F.split("phrase", " ")
    pairs = pairs.select("phrase", "count", at[0].alias("a"), at[1].alias("b"))
    wanted = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("word")),
                                            F.struct(F.lit(1).alias("side"), F.col("b").alias("word")))).alias("s"))
    wanted = wanted.select("s.*").distinct()
    cut = spread(texts.select(text.alias("text")))
    total = cut.agg(F.sum(F.greatest(F.size(words(F.col("text"))) - 1, F.lit(0))).cast("double").alias("total"))
    ends = cut.select(F.explode(F.transform(F.array(words(F.col("text"))), sides)[0]).alias("s")).select("s.*")
    margin = ends.join(wanted, ["side", "word"], "left_semi").groupBy("side", "word").agg(F.count("*").alias("m"))
    margin = margin.checkpoint()
    first = margin.where("side = 0").select(F.col("word").alias("a"), F.col("m").alias("n_first"))
    second = margin.where("side = 1").select(F.col("word").alias("b"), F.col("m").alias("n_second"))
    n = total.first()["total"] or 0.0  # one number
    score = log_likelihood(F.col("count"), F.col("n_first"), F.col("n_second"), F.lit(float(n)))
    return (pairs.join(first, "a").join(second, "b")
            .select("phrase", "count", "n_first", "n_second", score.alias("score")))
