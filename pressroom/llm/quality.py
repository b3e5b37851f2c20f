"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule looks at one feature of a text and rejects the document when a limit is crossed.  On a bounded sample
``estimate`` measures what each rule costs (run time of a job that computes its feature, less that of a bare scan)
and how often it rejects; the cascade then runs the rules by rejections per cost, and every rule is evaluated only
for the documents that no earlier rule has rejected (``CASE WHEN alive THEN feature END`` is lazy).  The order
changes the cost, never the verdict: a document is kept when no rule rejects it.

Everything is computed inside the row that holds the text: the plan is one scan with projections, no shuffle.
Repeated 8-word windows are found by 64-bit hashes of the windows, within one document.

Defined results: a NULL or blank text has no words (all features 0) and fails ``min_words``; rows are judged one by
one, so repeated rows and repeated ids give repeated results; an empty table gives an empty table; other columns of
the input, whatever their names, pass through ``quality_filter`` unchanged and are ignored by ``quality_features``.
Texts of any length are read whole (arrays are bounded by one document's words).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import checkpointed, fresh

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Documents in the sample that the order of the rules is estimated on (the verdicts don't depend on it).
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _window_hashes(w: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    return F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(h: Column, s: Column) -> Column:
    """Words in windows whose hash occurs twice or more.  ``s``: (hash, start) pairs of all windows, sorted."""
    twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"),
                                 (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


#: feature -> steps that compute it from `text` and the words `w`; each step is a column of its own, so that what a
#: later step reads several times is computed once.  {} holds the columns so far.
FEATURES: dict[str, list[Callable[[dict[str, Column]], Column]]] = {
    "n_words": [lambda c: F.size(c["w"])],
    "word_chars": [lambda c: F.length(F.array_join(c["w"], ""))],
    "n_symbols": [lambda c: F.coalesce(F.length(c["text"]) - F.length(F.regexp_replace(c["text"], SYMBOLS, "")),
                                       F.lit(0))],
    "n_lines": [lambda c: _lines(c["text"]), lambda c: F.size(c["last"])],
    "n_dup_lines": [lambda c: _lines(c["text"]), lambda c: F.size(c["last"]) - F.size(F.array_distinct(c["last"]))],
    "n_repeat_words": [
        lambda c: _window_hashes(c["w"]),
        lambda c: F.struct(c["last"].alias("h"), F.when(
            F.size(F.array_distinct(c["last"])) < F.size(c["last"]),
            F.sort_array(F.transform(c["last"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s")),
        lambda c: F.when(c["last"]["s"].isNull(), F.lit(0)).otherwise(_covered(c["last"]["h"], c["last"]["s"]))],
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``fails`` holds of its features."""
    name: str
    reads: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


#: The limits are fixed values; base rules first, then the method's own.
RULES = (
    Rule("min_words", ("n_words",), lambda c: c["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
    Rule("symbols", ("n_symbols", "word_chars"), lambda c: 100 * c["n_symbols"] > 5 * c["word_chars"]),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda c: 100 * c["n_dup_lines"] > 50 * c["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"),
         lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
)
BASE = ("min_words", "repeats")


def _with_feature(df: DataFrame, name: str, cols: dict[str, str], alive: Column | None) -> DataFrame:
    """Add one feature (unless there); ``alive``: rows for which it is needed."""
    if name in cols:
        return df
    used = []
    for step in FEATURES[name]:
        at, = fresh(df, f"q_{name}_{len(used)}")
        have = {k: F.col(v) for k, v in cols.items()} | ({"last": F.col(used[-1])} if used else {})
        value = step(have)
        df = df.withColumn(at, value if alive is None else F.when(alive, value))
        used.append(at)
    cols[name] = used[-1]
    return df.drop(*used[:-1])


def _prepare(df: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    w, = fresh(df, "q_words")
    return df.withColumn(w, words(F.col(text_col))), {"text": text_col, "w": w}


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and every feature (long) of every row."""
    df, cols = _prepare(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    for name in FEATURES:
        df = _with_feature(df, name, cols, None)
    return df.select("doc_id", *[F.col(cols[n]).cast("bigint").alias(n) for n in FEATURES])


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds) and rejected share of each rule on a sample of about ``sample_rows`` documents."""
    n = docs.count()
    sample = checkpointed(docs.select(F.col(text_col).alias("text"))
                          .sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=7))

    def timed(rule: Rule | None) -> tuple[float, float]:
        df, cols = _prepare(sample, "text")
        for name in rule.reads if rule else ():
            df = _with_feature(df, name, cols, None)
        fails = rule.fails({k: F.col(v) for k, v in cols.items()}) if rule else F.size(cols["w"]) < 0
        began = time.perf_counter()
        share = df.agg(F.avg(fails.cast("int")).alias("x")).first()["x"] or 0.0
        return time.perf_counter() - began, share

    timed(None)  # compiles what all rules share
    bare = timed(None)[0]
    out = []
    for rule in rules:
        took, share = timed(rule)
        out.append({"rule": rule.name, "cost": max(took - bare, 1e-3), "rejects": share})
    return out


def order_rules(estimates: list[dict], rules=RULES) -> list[Rule]:
    """Rules by rejections per cost, best first; ties keep the given order."""
    by = {e["rule"]: e["rejects"] / e["cost"] for e in estimates}
    return sorted(rules, key=lambda r: -by[r.name])


def run_cascade(df: DataFrame, ordered, cols: dict[str, str]) -> tuple[DataFrame, str]:
    """Add a column with the name of the first rule in ``ordered`` that rejects the row, NULL if none does.
    ``cols``: columns that hold `text`, `w` and the features already there."""
    verdict, = fresh(df, "rejected_by")
    df = df.withColumn(verdict, F.lit(None).cast("string"))
    for rule in ordered:
        alive = F.col(verdict).isNull()
        for name in rule.reads:
            # a feature computed only for the rows alive now serves every later rule: rows only leave
            df = _with_feature(df, name, cols, alive)
        fails = rule.fails({k: F.col(v) for k, v in cols.items()})
        df = df.withColumn(verdict, F.when(alive, F.when(fails, F.lit(rule.name))).otherwise(F.col(verdict)))
    # exploding an array of one keeps a later filter on the verdict from being pushed down through the steps above,
    # where each use of a column would become a copy of everything that makes it
    return df.withColumn(verdict, F.explode(F.array(F.col(verdict)))), verdict


def quality_filter(docs: DataFrame, rules=RULES, order=None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all their columns) that no rule rejects; ``order``: rules in the order to run, by
    default estimated on a sample."""
    order = order or order_rules(estimate(docs, rules, text_col), rules)
    df, cols = _prepare(docs, text_col)
    df, verdict = run_cascade(df, order, cols)
    return df.filter(F.col(verdict).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, rules=RULES, order=None) -> DataFrame:
    """Every feature of every row, ``base_failed`` and ``kept`` (the cascade's verdict)."""
    order = order or order_rules(estimate(docs, rules), rules)
    feats = quality_features(docs)
    df, verdict = run_cascade(feats, order, {n: n for n in FEATURES})
    base = {r.name: r.fails({n: F.col(n) for n in FEATURES}) for r in RULES if r.name in BASE}
    return df.select(*feats.columns, (base["min_words"] | base["repeats"]).alias("base_failed"),
                     F.col(verdict).isNull().alias("kept"))
