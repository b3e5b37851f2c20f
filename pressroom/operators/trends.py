"""Trends: in how many articles a term occurs per event-time window, and when it bursts.

Windows are counted by one aggregation (each article's distinct terms once, map-side combine), in batch or as a stream with
a watermark: a window closes when the watermark passes it, later articles for it are dropped, earlier late ones count.  The
row with the empty term holds the number of articles of a window.

Bursts follow a two-state automaton: in state 0 a term is expected in its overall share of articles, in state 1 in ``RATIO``
times that share (capped below 1); going up costs ``GAMMA`` x ln(windows), going down nothing.  The cheapest state sequence is
found over the dense, ordered windows of each term, natively, in one aggregate over an array; the array is as long as
there are windows, whatever the number of articles.  Equal costs choose state 0.

NULL texts have no terms but count as articles; rows without a time are left out; repeated rows count again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressroom.operators.search_index import words

HOURS, RATIO, GAMMA, MIN_ARTICLES, MOST = 6, 2.0, 1.0, 20, 0.9999


def _counted(articles: DataFrame, hours: int, text_col: str, time_col: str) -> DataFrame:
    terms = F.array_union(F.array(F.lit("")), words(F.col(text_col)))  # distinct, and the empty one
    return (articles.select(F.col(time_col).alias("at"), F.explode(terms).alias("term"))
            .groupBy(F.window("at", f"{hours} hours").alias("w"), "term").agg(F.count("*").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("start"), "term", "n"))


def term_windows(articles: DataFrame, hours: int = HOURS, text_col: str = "title", time_col: str = "scraped_at") -> DataFrame:
    """start, term, n: articles of each window that hold the term; term '' counts all."""
    return _counted(articles.where(F.col(time_col).isNotNull()), hours, text_col, time_col)


def stream_term_windows(articles: DataFrame, out: str, checkpoint: str, late: str = "12 hours", hours: int = HOURS,
                        text_col: str = "title", time_col: str = "scraped_at", trigger: dict | None = None) -> StreamingQuery:
    """The same rows from a stream of articles, appended to the Parquet folder ``out`` when their window closes."""
    timed = articles.withColumn("_at", F.col(time_col).cast("timestamp")).where("_at IS NOT NULL").withWatermark("_at", late)
    return (_counted(timed, hours, text_col, "_at").writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _states(windows: Column, r: Column, p0: Column, p1: Column, up: float) -> Column:
    """The cheapest states as a string of 0 and 1; ``r`` maps a window's number to the term's articles."""
    def run(m: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            n = F.coalesce(F.element_at(m["r"], w["t"]), F.lit(0)).cast("double")
            rest = w["d"].cast("double") - n
            cost0 = -(n * m["a0"] + rest * m["b0"])
            cost1 = -(n * m["a1"] + rest * m["b1"])
            low, high = acc["c0"] <= acc["c1"], acc["c1"] <= acc["c0"] + up
            return F.struct((F.when(low, acc["c0"]).otherwise(acc["c1"]) + cost0).alias("c0"),
                            (F.when(high, acc["c1"]).otherwise(acc["c0"] + up) + cost1).alias("c1"),
                            F.concat(F.when(low, acc["s0"]).otherwise(acc["s1"]), F.lit("0")).alias("s0"),
                            F.concat(F.when(high, acc["s1"]).otherwise(acc["s0"]), F.lit("1")).alias("s1"))

        start = F.struct(F.lit(0.0).alias("c0"), F.lit(1e300).alias("c1"), F.lit("").alias("s0"), F.lit("").alias("s1"))
        return F.aggregate(windows, start, step, lambda a: F.when(a["c0"] <= a["c1"], a["s0"]).otherwise(a["s1"]))

    bound = F.struct(r.alias("r"), F.ln(p0).alias("a0"), F.ln(1 - p0).alias("b0"), F.ln(p1).alias("a1"),
                     F.ln(1 - p1).alias("b1"))
    return F.transform(F.array(bound), run)[0]  # bound once for all windows


def term_bursts(counts: DataFrame, hours: int = HOURS, ratio: float = RATIO, gamma: float = GAMMA,
                min_articles: int = MIN_ARTICLES) -> DataFrame:
    """term, start, end, n_windows, n: the windows each term of at least ``min_articles`` articles is in state 1, and its
    articles in them.  ``counts``: rows of :func:`term_windows`."""
    spark = counts.sparkSession
    totals = counts.where("term = ''").groupBy("start").agg(F.sum("n").alias("d"))
    got = [(r.start, r.d) for r in totals.orderBy("start").collect()]  # a row a window
    if not got:
        return spark.createDataFrame([], "term string, start timestamp_ntz, end timestamp_ntz, n_windows long, n long")
    first, width = got[0][0], hours * 3600
    number = {int((s - first).total_seconds() // width): d for s, d in got}
    n_windows = max(number) + 1
    dense = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(int(number.get(t, 0))).cast("long").alias("d"))
                      for t in range(n_windows)))
    t = ((F.unix_seconds(F.col("start").cast("timestamp")) - F.unix_seconds(F.lit(first).cast("timestamp"))) / width).cast("int")
    per = (counts.where("term <> ''").groupBy("term", t.alias("t")).agg(F.sum("n").alias("n")).groupBy("term")
           .agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("r"))
           .where(F.col("all") >= min_articles))
    p0 = F.least(F.col("all") / float(sum(number.values())), F.lit(MOST / ratio))
    states = _states(dense, F.col("r"), p0, p0 * ratio, gamma * math.log(n_windows))
    on = (per.select("term", "r", F.posexplode(F.split(states, "")).alias("t", "state")).where("state = '1'")
          .select("term", "t", F.coalesce(F.element_at("r", F.col("t")), F.lit(0)).alias("n")))
    island = F.col("t") - F.row_number().over(Window.partitionBy("term").orderBy("t"))  # at most a row a window
    runs = (on.withColumn("island", island).groupBy("term", "island")
            .agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("n").alias("n")))
    at = lambda c: (F.lit(first) + F.make_dt_interval(secs=(c * width).cast("decimal(18,6)")))
    return runs.select("term", at(F.col("a")).alias("start"), at(F.col("b") + 1).alias("end"),
                       (F.col("b") - F.col("a") + 1).cast("long").alias("n_windows"), F.col("n").cast("long").alias("n"))
