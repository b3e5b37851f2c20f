"""Listing search predicate.

The listing's search is ``title contains q OR perex contains q`` compiled to
``LIKE '%q%'`` without escaping, so '%' and '_' typed by the user stay wildcards, and
matching folds case for ASCII letters only.  We reproduce that with ``translate``
(A-Z -> a-z on both sides; not ``lower``/``ilike``, which fold all of Unicode) and
double every backslash, because Spark's LIKE uses backslash as its escape character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------------------


def fold_ascii(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def like_term(q: str) -> str:
    """The LIKE pattern for a search term: ASCII-folded, backslashes literal,
    wildcards live."""
    folded = q.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    return "%" + folded.replace("\\", "\\\\") + "%"


def contains_folded(c, q: str) -> Column:
    return fold_ascii(c).like(like_term(q))


def search_predicate(q: str | None, columns=("title", "perex")) -> Column | None:
    """None when the term is falsy (no filter)."""
    if not q:
        return None
    pred = None
    for c in columns:
        p = contains_folded(c, q)
        pred = p if pred is None else (pred | p)
    return pred
