"""DuckDB spellings of the pressroom functions, used to write the oracle SQL.

Each helper returns a SQL expression string; they mirror ``pressroom.functions`` one
for one (RE2 character classes, ASCII-only case folding for search)."""

from __future__ import annotations

from pressroom.functions.text import WS_CLASS

WS = WS_CLASS  # RE2 accepts the same \x{..} spelling as Java


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean_text(x: str) -> str:
    return f"coalesce(translate({strip_ws(x)}, chr(10) || chr(13) || chr(9), '   '), '')"


def normalize_title(x: str) -> str:
    s = strip_ws(f"lower({x})")
    s = f"regexp_replace({s}, '[^\\pL\\pN_{WS}]', '', 'g')"
    return f"regexp_replace({s}, '[{WS}]+', ' ', 'g')"


def title_hash(x: str) -> str:
    return f"md5({normalize_title(x)})"


def normalize_url(u: str, base: str) -> str:
    b = f"regexp_replace({base}, '/+$', '')"
    uu = f"coalesce({u}, '')"
    return (f"(CASE WHEN {uu} = '' THEN '' WHEN starts_with({uu}, '/') THEN {b} || {uu} "
            f"WHEN NOT starts_with({uu}, 'http') THEN {b} || '/' || {uu} ELSE {uu} END)")


def fold_ascii(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def like_term(q: str) -> str:
    # DuckDB LIKE has no default escape character: the term goes in as typed.
    folded = q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return sq("%" + folded + "%")


def search_pred(q: str | None) -> str | None:
    if not q:
        return None
    t = like_term(q)
    return f"({fold_ascii('title')} LIKE {t} OR {fold_ascii('perex')} LIKE {t})"


def listing_where(source: str | None, search: str | None) -> str:
    preds = []
    if source:
        preds.append(f"source = {sq(source)}")
    sp = search_pred(search)
    if sp:
        preds.append(sp)
    return ("WHERE " + " AND ".join(preds)) if preds else ""


def initcap(x: str) -> str:
    # every run of letters: first letter upper, rest lower
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\pL+|[^\\pL]+'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


ARTICLES_VIEW = f"""
  SELECT doc_id AS id,
         {clean_text('text')} AS title,
         substr({clean_text('text')}, 1, 500) AS perex,
         source,
         'https://' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) AS url,
         lang,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 97 AS BIGINT)) AS scraped_at
  FROM documents"""

ARTICLES = f"""
  SELECT id, title, perex, source, url, {title_hash('title')} AS title_hash, scraped_at,
         scraped_at AS updated_at, lang
  FROM ({ARTICLES_VIEW}) av0"""
