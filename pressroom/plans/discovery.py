"""Registered queries over the features that find and follow stories: ranked search, similarity, clusters, trends.

Each reads whole driver tables; the DuckDB SQL beside it must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroom.operators import search_index as SI
from pressroom.plans import fixtures as FX
from pressroom.plans import oracle as O
from pressroom.plans.catalog import register
from pressroom.session import checkpoint_dir

# --------------------------------------------------------------------------- ranked search
RANKED = {"common": "the of", "german": "nicht und die", "french": "la de les", "mixed": "The la, die!", "rare": "ation heit zzz"}
RANKED_K = 20
PHRASES = {"en": "of the", "de": "und die", "fr": "de la", "one": "nicht", "none": "zzz the"}


def _words_sql(text: str = "text") -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\pL\\pN]+')"


def _ranked_sql() -> str:
    parts = []
    for q, text in RANKED.items():
        terms = SI.query_terms(text)
        sums = " + ".join(f"coalesce(max(CASE WHEN term = {O.sq(t)} THEN w END), 0)" for t in terms)
        parts.append(f"""
SELECT {O.sq(q)} AS query, row_number() OVER (ORDER BY s DESC, doc_id) AS rank, doc_id AS id, s AS score
FROM (SELECT doc_id, round({sums}, {SI.PLACES}) AS s FROM weighted WHERE term IN ({', '.join(map(O.sq, terms))})
      GROUP BY doc_id) x QUALIFY rank <= {RANKED_K}""")
    return f"""
WITH d AS (SELECT doc_id, {_words_sql()} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
weighted AS (SELECT tf.doc_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
                    * (tf * ({SI.K1}::DOUBLE + 1) / (tf + {SI.K1}::DOUBLE * (1 - {SI.B}::DOUBLE + {SI.B}::DOUBLE * len(w) / mean))) AS w
             FROM tf JOIN df USING (term) JOIN d USING (doc_id), m)
SELECT query, rank::INTEGER AS rank, id, round(score, 6) AS score FROM ({' UNION ALL '.join(parts)})"""


@register("search_ranked", _ranked_sql())
def q_search_ranked(spark, sf_dir):
    """BM25 top 20 of five searches over an index of all documents."""
    index = SI.fresh_index(FX.table(spark, sf_dir, "documents"))
    out = SI.search_ranked(spark, index, RANKED, RANKED_K)
    return out.withColumn("score", F.round("score", 6))


def _phrase_sql() -> str:
    parts = []
    for q, text in PHRASES.items():
        ts = text.split()
        here = " AND ".join(f"w[i + {j}] = {O.sq(t)}" for j, t in enumerate(ts))
        parts.append(f"SELECT {O.sq(q)} AS query, doc_id AS id, "
                     f"len(list_filter(range(1, len(w) + 1), lambda i: {here}))::BIGINT AS hits FROM d")
    return f"""WITH d AS (SELECT doc_id, {_words_sql()} AS w FROM documents)
SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0"""


@register("search_phrase", _phrase_sql())
def q_search_phrase(spark, sf_dir):
    """Every document that holds one of five phrases, from the positions of the index."""
    return SI.search_phrase(spark, SI.fresh_index(FX.table(spark, sf_dir, "documents")), PHRASES)


# --------------------------------------------------------------------------- similarity
@register("similar_rows")
def q_similar_rows(spark, sf_dir):
    """The ten nearest rows of every embedding whose id is divisible by 50 (approximate; tests hold the recall)."""
    from pressroom.operators.similarity import nearest_rows
    found = nearest_rows(FX.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumn("cosine", F.round("cosine", 6))


# --------------------------------------------------------------------------- stories
def _stories_sql() -> str:
    from pressroom.operators import stories as ST
    n = ST.SHINGLE
    return f"""
a AS ({O.ARTICLES}),
w AS (SELECT id, source, scraped_at, list_filter(string_split({O.normalize_title('title')}, ' '), lambda x: x <> '') AS w FROM a),
sig AS (SELECT id, scraped_at, unnest(list_sort(list_distinct(
            [md5(array_to_string(w[i:i + {n - 1}], ' ')) FOR i IN range(1, greatest(len(w) - {n - 1}, 1) + 1)]))[1:{ST.SIGNATURE}]) AS k
        FROM w WHERE len(w) > 0),
nx AS (SELECT id AS p, lag(id) OVER o AS q, epoch(scraped_at) - lag(epoch(scraped_at)) OVER o AS gap
       FROM sig WINDOW o AS (PARTITION BY k ORDER BY scraped_at, id)),
near AS (SELECT p, q FROM nx WHERE gap <= {ST.HOURS * 3600} AND p <> q),
lk AS (SELECT p, q FROM near UNION SELECT q, p FROM near),
st(id, story) USING KEY (id) AS (
    SELECT id, id FROM a UNION
    SELECT lk.p, min(v.story) FROM st v JOIN lk ON lk.q = v.id JOIN recurring.st u ON u.id = lk.p
    WHERE v.story < u.story GROUP BY lk.p)"""


@register("story_clusters", f"WITH RECURSIVE {_stories_sql()} SELECT id, story FROM st")
def q_story_clusters(spark, sf_dir):
    """Stories over all articles, built in two batches that both hold articles of all times."""
    return _stories(spark, sf_dir)[1]


def _stories(spark, sf_dir):
    from pressroom.operators import stories as ST
    from pressroom.session import scratch_path
    arts = FX.articles_view(spark, sf_dir)
    path = scratch_path(spark, "stories")
    odd = F.col("id") % 2 == 1
    ST.update_stories(arts.where(odd), path, 0)
    ST.update_stories(arts.where(~odd), path, 1)
    return arts, ST.read_stories(spark, path)


@register("story_coverage", f"""WITH RECURSIVE {_stories_sql()},
per AS (SELECT story, source, count(*) AS n_articles, min(scraped_at) AS first_at, max(scraped_at) AS last_at
        FROM a JOIN st USING (id) GROUP BY story, source)
SELECT story, source, n_articles, first_at, last_at,
       row_number() OVER (PARTITION BY story ORDER BY first_at, source)::INTEGER AS place,
       (epoch(first_at) - epoch(min(first_at) OVER (PARTITION BY story)))::BIGINT AS lag_seconds,
       lag(source) OVER (PARTITION BY story ORDER BY first_at, source) AS after_source
FROM per""")
def q_story_coverage(spark, sf_dir):
    """Which sources took up each story, when, and after whom."""
    from pressroom.operators import stories as ST
    arts, told = _stories(spark, sf_dir)
    return ST.story_coverage(told, arts)


# --------------------------------------------------------------------------- trends
_WINDOWS_SQL = f"""
a AS ({O.ARTICLES}),
n0 AS (SELECT time_bucket(INTERVAL '6 hours', scraped_at) AS start, unnest(list_append(list_distinct({_words_sql('title')}), '')) AS term
       FROM a),
c AS (SELECT start, term, count(*) AS n FROM n0 GROUP BY start, term)"""


@register("term_windows", f"WITH {_WINDOWS_SQL} SELECT start, term, n FROM c")
def q_term_windows(spark, sf_dir):
    """Articles per six-hour window and term."""
    from pressroom.operators import trends as TR
    return TR.term_windows(FX.articles_view(spark, sf_dir))


def _bursts_sql() -> str:
    from pressroom.operators import trends as TR
    def cost(q):
        return f"(-(n * ln(p{q}) + (d - n) * ln(1 - p{q})))"
    return f"""
WITH RECURSIVE {_WINDOWS_SQL},
tot AS (SELECT start, n AS d FROM c WHERE term = ''),
ws AS (SELECT t, start, coalesce(d, 0)::DOUBLE AS d FROM
       (SELECT unnest(generate_series((SELECT min(start) FROM tot), (SELECT max(start) FROM tot), INTERVAL '6 hours')) AS start)
       LEFT JOIN tot USING (start), LATERAL (SELECT (epoch(start) - (SELECT min(epoch(start)) FROM tot)) / 21600 AS t)),
k AS (SELECT term, least(sum(n) / (SELECT sum(d) FROM ws), {TR.MOST / TR.RATIO}::DOUBLE) AS p0 FROM c WHERE term <> ''
      GROUP BY term HAVING sum(n) >= {TR.MIN_ARTICLES}),
x AS (SELECT term, t::INTEGER AS t, p0, p0 * {TR.RATIO}::DOUBLE AS p1, d, coalesce(n, 0)::DOUBLE AS n
      FROM k CROSS JOIN ws LEFT JOIN c USING (term, start)),
up AS (SELECT {TR.GAMMA}::DOUBLE * ln(count(*)) AS u FROM ws),
v(term, t, c0, c1, s0, s1) AS (
  SELECT term, -1, 0::DOUBLE, 1e300::DOUBLE, '', '' FROM k
  UNION ALL
  SELECT v.term, x.t, least(c0, c1) + {cost(0)}, CASE WHEN c1 <= c0 + u THEN c1 ELSE c0 + u END + {cost(1)},
         CASE WHEN c0 <= c1 THEN s0 ELSE s1 END || '0', CASE WHEN c1 <= c0 + u THEN s1 ELSE s0 END || '1'
  FROM v JOIN x ON x.term = v.term AND x.t = v.t + 1, up),
f AS (SELECT term, CASE WHEN c0 <= c1 THEN s0 ELSE s1 END AS s FROM v WHERE t = (SELECT max(t) FROM ws)),
e AS (SELECT x.term, x.t, x.n, x.t - row_number() OVER (PARTITION BY x.term ORDER BY x.t) AS island
      FROM x JOIN f USING (term) WHERE f.s[x.t + 1] = '1')
SELECT term, (SELECT min(start) FROM tot) + min(t) * INTERVAL '6 hours' AS start,
       (SELECT min(start) FROM tot) + (max(t) + 1) * INTERVAL '6 hours' AS "end", count(*) AS n_windows, sum(n)::BIGINT AS n
FROM e GROUP BY term, island"""


@register("term_bursts", _bursts_sql())
def q_term_bursts(spark, sf_dir):
    """When terms of at least 20 articles burst: two-state automaton over six-hour windows."""
    from pressroom.operators import trends as TR
    checkpoint_dir(spark)
    return TR.term_bursts(TR.term_windows(FX.articles_view(spark, sf_dir)).checkpoint())


# --------------------------------------------------------------------------- phrases
PHRASE_TOP, PAIRS_TOP = 50, 200


def _grams_sql(n: int) -> str:
    return (f"SELECT unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, greatest(len(w) - {n - 2}, 1))]) AS phrase "
            f"FROM (SELECT {_words_sql()} AS w FROM documents)")


@register("phrase_top", " UNION ALL ".join(f"""
SELECT * FROM (SELECT {n} AS n, row_number() OVER (ORDER BY count DESC, phrase)::INTEGER AS rank, phrase, count
               FROM (SELECT phrase, count(*) AS count FROM ({_grams_sql(n)}) GROUP BY phrase)) WHERE rank <= {PHRASE_TOP}"""
                                           for n in (2, 3)))
def q_phrase_top(spark, sf_dir):
    """The 50 most frequent pairs and triples of words of all documents, exactly."""
    from pressroom.operators import phrases as PH
    docs = FX.table(spark, sf_dir, "documents")
    return PH.top_ngrams(docs, 2, PHRASE_TOP).unionByName(PH.top_ngrams(docs, 3, PHRASE_TOP))


@register("phrase_association", f"""
WITH g AS ({_grams_sql(2)}),
c AS (SELECT phrase, count(*) AS k, split_part(phrase, ' ', 1) AS a, split_part(phrase, ' ', 2) AS b FROM g GROUP BY phrase),
fa AS (SELECT a, sum(k)::DOUBLE AS na FROM c GROUP BY a),
fb AS (SELECT b, sum(k)::DOUBLE AS nb FROM c GROUP BY b),
t AS (SELECT sum(k)::DOUBLE AS n FROM c),
top AS (SELECT * FROM c ORDER BY k DESC, phrase LIMIT {PAIRS_TOP}),
x AS (SELECT phrase, k, na, nb, n, k::DOUBLE AS k11, na - k AS k12, nb - k AS k21, n - na - nb + k AS k22
      FROM top JOIN fa USING (a) JOIN fb USING (b), t)
SELECT phrase, k AS count, na::BIGINT AS n_first, nb::BIGINT AS n_second, round(2 * (
       CASE WHEN k11 > 0 THEN k11 * ln(k11 * n / (na * nb)) ELSE 0 END
     + CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / (na * (n - nb))) ELSE 0 END
     + CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((n - na) * nb)) ELSE 0 END
     + CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((n - na) * (n - nb))) ELSE 0 END), 3) AS score FROM x""")
def q_phrase_association(spark, sf_dir):
    """How strongly the words of the 200 most frequent pairs belong together."""
    from pressroom.operators import phrases as PH
    docs = FX.table(spark, sf_dir, "documents")
    checkpoint_dir(spark)
    found = PH.associations(docs, PH.top_ngrams(docs, 2, PAIRS_TOP))
    return found.withColumn("score", F.round("score", 3))


# --------------------------------------------------------------------------- sessions
_SESSIONS_SQL = """
e AS (SELECT event_id, user_id, ts, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL '6 hours' THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM p)"""


@register("event_sessions", f"""WITH {_SESSIONS_SQL}
SELECT user_id, session, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def q_event_sessions(spark, sf_dir):
    """Sessions of all events: no pause over six hours."""
    from pressroom.operators import sessions as SE
    return SE.sessions(FX.table(spark, sf_dir, "events"))


@register("event_funnel", f"""WITH {_SESSIONS_SQL},
a AS (SELECT user_id, session, min(struct_pack(ts := ts, id := event_id)) AS at FROM s WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT s.user_id, s.session, min(struct_pack(ts := ts, id := event_id)) AS at FROM s JOIN a USING (user_id, session)
      WHERE event_type = 'click' AND struct_pack(ts := ts, id := event_id) > a.at GROUP BY ALL),
c AS (SELECT s.user_id, s.session, min(struct_pack(ts := ts, id := event_id)) AS at FROM s JOIN b USING (user_id, session)
      WHERE event_type = 'purchase' AND struct_pack(ts := ts, id := event_id) > b.at GROUP BY ALL)
SELECT user_id, session, (a.at IS NOT NULL)::INTEGER + (b.at IS NOT NULL)::INTEGER + (c.at IS NOT NULL)::INTEGER AS reached,
       a.at.ts AS step_1, b.at.ts AS step_2, c.at.ts AS step_3
FROM (SELECT DISTINCT user_id, session FROM s) LEFT JOIN a USING (user_id, session) LEFT JOIN b USING (user_id, session)
     LEFT JOIN c USING (user_id, session)""")
def q_event_funnel(spark, sf_dir):
    """How far each session gets from a view to a click to a purchase."""
    from pressroom.operators import sessions as SE
    checkpoint_dir(spark)
    return SE.funnel(FX.table(spark, sf_dir, "events"))
