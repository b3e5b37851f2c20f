"""Benchmark decontamination by winnowing (DataFrame functions only).

A document word is hit when it lies in an occurrence of a benchmark window: 13 consecutive words of an item, or the
whole item if it has fewer (but some).  Both sides are fingerprinted alike: hash every k-gram of words, keep the
minimum hash of each sliding run of w of them; with k + w - 1 = window length every window leaves at least one
fingerprint, so every shared window makes document and benchmark share one.  Fingerprints of all documents join
those of the benchmark; in the documents so found each hit is extended to the window (its first and last k-gram
together span all its words) and joined with the benchmark's windows, and hit words and items are collected.

Plan: scan 1 turns each document into its distinct fingerprints, which join the distinct fingerprints of the
benchmark (broadcast under a counted size, else shuffled) and fold back to one row per document before any shuffle;
scan 2 reads only the documents with a hit.  Windows with the same items share one item list, so hot passages cost
one row per document and list, not one per pair.

Defined results: NULL or wordless texts have 0 words, 0 hits; wordless items never match; rows repeating both id and
text are one document (one result row), rows with the same id and different texts are separate documents; repeated
items count once; items with a NULL id mark words as hit but are not listed; an empty benchmark leaves every
document clean; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import checkpointed, small_side

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
GRAM = 8


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def _grams(w: Column, n: int) -> Column:
    """One hash for each run of ``n`` words."""
    starts = F.sequence(F.lit(0), F.size(w) - n)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))
    return F.when(F.size(w) >= n, hashes).otherwise(F.array().cast("array<bigint>"))


def _minima(g: Column, span: int) -> Column:
    """The minimum of each run of ``span`` hashes, without repeats."""
    if span == 1:
        return F.array_distinct(g)
    starts = F.sequence(F.lit(0), F.size(g) - span)
    least = F.transform(starts, lambda i: F.least(*[F.get(g, i + j) for j in range(span)]))
    return F.when(F.size(g) >= span, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _gram_of(length: int, gram: int = GRAM) -> int:
    return min(gram, length)


def _fingerprints(df: DataFrame, lengths: list[int]) -> Column:
    """All fingerprints of the row's words, for windows of each of ``lengths``; needs the columns of ``_gramed``."""
    return F.array_distinct(F.concat(*[_minima(F.col(f"g{_gram_of(n)}"), n - _gram_of(n) + 1) for n in lengths]))


def _gramed(df: DataFrame, lengths: list[int]) -> DataFrame:
    for k in sorted({_gram_of(n) for n in lengths}):
        df = df.withColumn(f"g{k}", _grams(F.col("w"), k))
    return df


def _windows(df: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """A row for each window: its length, start, and the hashes of its first and last gram."""
    def of(n: int) -> Column:
        k = _gram_of(n)
        g = F.col(f"g{k}")
        starts = F.sequence(F.lit(0), F.size(g) - (n - k + 1))
        rows = F.transform(starts, lambda i: F.struct(F.lit(n).alias("len"), i.alias("at"), F.get(g, i).alias("g0"),
                                                      F.get(g, i + n - k).alias("g1")))
        return F.when(F.size(g) >= n - k + 1, rows).otherwise(F.array().cast(rows_type))
    rows_type = "array<struct<len:int,at:int,g0:bigint,g1:bigint>>"
    return df.select(*keep, F.inline(F.concat(*[of(n).cast(rows_type) for n in lengths])))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """(fingerprints, windows with the key of their item list, item lists, window lengths) of the benchmark."""
    items = checkpointed(benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
                         .filter(F.size("w") > 0).dropDuplicates())
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(window))).distinct().collect())
    if not lengths:
        lengths = [window]
    df = _gramed(items.withColumn("own", F.least(F.size("w"), F.lit(window))), lengths)
    prints, wins = [], []
    for n in lengths:  # at most `window` of them
        own = df.filter(F.col("own") == n)
        prints.append(own.select(F.explode(_fingerprints(own, [n])).alias("fp")))
        wins.append(_windows(own, ["item"], [n]))
    all_prints, all_wins = prints[0], wins[0]
    for p, w in zip(prints[1:], wins[1:]):
        all_prints, all_wins = all_prints.unionByName(p), all_wins.unionByName(w)
    listed = checkpointed(all_wins.groupBy("len", "g0", "g1")
                          .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
                          .withColumn("list", F.xxhash64("items", F.size("items"))))
    return (checkpointed(all_prints.distinct()), listed.drop("items"),
            listed.select("list", "items").dropDuplicates(["list"]), lengths)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  min_share: int = 20) -> DataFrame:
    """Per document: (doc_id, text_key, n_words, n_hit, items, contaminated); ``items``: sorted distinct ids as
    strings; ``contaminated``: n_hit > 0 and min_share * n_hit >= n_words."""
    prints, wins, lists, lengths = benchmark_windows(benchmark, window, item_col, item_text)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = ["doc_id", "text_key"]
    read = read.withColumn("text_key", F.xxhash64("text"))
    first = _gramed(read.select(*key, words(F.col("text")).alias("w")), lengths)
    first = first.select(*key, F.size("w").alias("n_words"),
                         F.explode_outer(_fingerprints(first, lengths)).alias("fp"))
    found = first.join(small_side(prints.withColumn("known", F.lit(1)), 40), "fp", "left")
    per_doc = checkpointed(found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.max("known").alias("known")))
    hits = checkpointed(per_doc.filter("known = 1").select(*[F.col(c).alias(f"h_{c}") for c in key]))
    same = F.expr("doc_id <=> h_doc_id AND text_key = h_text_key")
    again = read.join(small_side(hits, 60), same, "left_semi")
    second = _gramed(again.select(*key, words(F.col("text")).alias("w")), lengths)
    matched = (_windows(second, key, lengths).join(small_side(wins, 80), ["len", "g0", "g1"])
               .select(*key, "at", "len", "list"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["len"]).alias("end"),
                                 (a["n"] + F.greatest(s["at"] + s["len"] - F.greatest(a["end"], s["at"]),
                                                      F.lit(0))).alias("n"))
    covered = matched.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"), F.collect_set("list").alias("lists"))
    covered = covered.select(*key, F.aggregate("spans", zero, step, lambda a: a["n"]).alias("n_hit"), "lists")
    covered = checkpointed(covered)
    items = (covered.select(*key, F.explode("lists").alias("list")).join(lists, "list")
             .select(*key, F.explode("items").alias("item")).distinct()
             .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items")))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in key],
                                   *[c for c in df.columns if c not in key])
    out = (per_doc.drop("known")
           .join(side(covered.drop("lists"), "c"), F.expr("doc_id <=> c_doc_id AND text_key = c_text_key"), "left")
           .join(side(items, "i"), F.expr("doc_id <=> i_doc_id AND text_key = i_text_key"), "left"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(*key, F.col("n_words").cast("bigint"), n_hit.cast("bigint").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (min_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` (all their columns, repeated rows included) that are not contaminated."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    bad = checkpointed(bad.select(F.col("doc_id").alias("bad_doc"), F.col("text_key").alias("bad_key")))
    d = docs.alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("bad_doc")) & (F.xxhash64(f"d.{text_col}") == F.col("bad_key"))
    return d.join(small_side(bad, 60), same, "left_anti")
