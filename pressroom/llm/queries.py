"""The registered queries of this subpackage: one ``opN_<name>`` per operator, over its whole table, with DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import (alignment, bpe, compact_windows, conversation, embedding_dedup, html_text, suffix_dedup,
                           token_files, toxicity)
from pressroom.llm.common import table
from pressroom.llm.decontaminate import LOWER, UPPER, contamination
from pressroom.llm.pii import BASE_KINDS, find_pii, spans_text
from pressroom.llm.quality import quality_report
from pressroom.llm.simhash import simhash_components


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = quality_report(table(spark, sf_dir, "documents"))
    return rep.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


SQL_OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
x AS (SELECT f.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM f LEFT JOIN cov USING (doc_id)),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM y
"""


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL_OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
             FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passage_classes(table(spark, sf_dir, "documents"))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, html_text.train(pages))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(spark, table(spark, sf_dir, "documents"))


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    # (a lambda's second argument would be the position, so the kind comes by closure)
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k))
    n = [of(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *n, F.sha2(spans_text(base), 256).alias("base_sha256"),
                      spans_text(F.col("found")).alias("spans"))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation.damage(table(spark, sf_dir, "conversations"))
    return conversation.repair_conversations(damaged, present="present")


def _sql_op13() -> str:
    """The same contract as a recursive CTE: per conversation one row a step, per pattern state the least
    "cost, audit" as a nine-digit cost and the letters, relaxed three times by inserts before each row."""
    states = ("z", "s", "u", "a")  # nothing yet, after a system row, after a user row, after an assistant row
    after = {"z": ("u", "u"), "s": ("u", "u"), "u": ("a", "a"), "a": ("u", "u")}

    def plus(x, cost, letter):
        return f"lpad((substr({x}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"

    def relaxed(p):  # inserts: every state offers its next one
        sets = []
        for q in states:
            ways = [f"{p}{q}"] + [plus(f"{p}{o}", 2, "I") for o in states if after[o][1] == q]
            sets.append(f"least({', '.join(ways)}) AS {q}" if len(ways) > 1 else f"{ways[0]} AS {q}")
        return ", ".join(sets)

    step = []
    for q in states:
        ways = [plus(f"x.{q}", 3, "D")]
        for o in states:
            role, to = after[o]
            if to == q:
                ways.append(f"CASE WHEN NOT go AND c = '{role}' THEN {plus(f'x.{o}', 't', 'K')} END")
                ways.append(f"CASE WHEN NOT go AND c <> '{role}' THEN {plus(f'x.{o}', '2 + t', 'R')} END")
        if q == "s":
            ways.append(f"CASE WHEN NOT go AND c = 's' THEN {plus('x.z', 't', 'K')} END")
        step.append(f"least({', '.join(ways)}) AS {q}")
    row = "s.conv_id, s.i, " + ", ".join(f"s.{q}" for q in states)
    relax = (f"(SELECT conv_id, i, {relaxed('r2.')} FROM (SELECT conv_id, i, {relaxed('r1.')} FROM "
             f"(SELECT conv_id, i, {relaxed('s.')} FROM (SELECT {row} FROM steps s) s) r1) r2)")
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295::BIGINT, list_reduce(
             [ord(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
             lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1))), 4294967295::BIGINT)) % 20 AS k
         FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM src, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
flt AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
               NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, substr(role, 1, 1) AS c,
               lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
tok AS (SELECT *, blank OR seen AS go, CASE WHEN cut THEN 1 ELSE 0 END AS t FROM flt),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (NOT blank AND seen)::BIGINT AS duplicate,
               count(*) FILTER (NOT go AND cut)::BIGINT AS truncated,
               count(*) FILTER (before || c NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n
        FROM tok GROUP BY conv_id),
steps AS (SELECT conv_id, 0 AS i, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM cnt
          UNION ALL
          SELECT x.conv_id, x.i + 1, {', '.join(step)} FROM {relax} x
          JOIN tok ON tok.conv_id = x.conv_id AND tok.i = x.i + 1),
fin AS (SELECT x.conv_id, least(x.z, x.a) AS best FROM {relax} x JOIN cnt ON cnt.conv_id = x.conv_id AND cnt.n = x.i),
res AS (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM fin),
let AS (SELECT conv_id, j, audit[j] AS l, j - (length(audit[:j]) - length(replace(audit[:j], 'I', ''))) AS i,
               length(replace(audit[:j], 'D', '')) AS o, length(replace(audit, 'D', '')) AS m
        FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM res)),
fix AS (SELECT conv_id, string_agg(
            CASE WHEN l = 'K' THEN role WHEN (o - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
            CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS out
        FROM let LEFT JOIN tok USING (conv_id, i) WHERE l <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN cnt USING (conv_id) LEFT JOIN res USING (conv_id) LEFT JOIN fix USING (conv_id)
"""


QUERIES = {
    "op1_simhash_near_dedup": q_op1,
    "op2_quality_rules": q_op2,
    "op3_bpe_round_trip": q_op3,
    "op4_suffix_array_dedup": q_op4,
    "op5_toxicity": q_op5,
    "op6_decontamination": q_op6,
    "op7_compact_windows": q_op7,
    "op8_html_extraction": q_op8,
    "op9_token_files": q_op9,
    "op10_pii": q_op10,
    "op11_embedding_near_dedup": q_op11,
    "op12_tokenizer_alignment": q_op12,
    "op13_conversation_repair": q_op13,
}
ORACLE = {
    "op2_quality_rules": SQL_OP2,
    "op6_decontamination": SQL_OP6,
    "op13_conversation_repair": _sql_op13(),
}
