"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, scheme separators, digits (for numbers) and
identifier cues such as ``token`` or ``iban``.  From an anchor a local, deterministic parser expands to both sides
and validates what it found: email and address bounds, number checks (Luhn, IBAN's remainder, part ranges), values
after a cue.  Nothing but the surroundings of an anchor is looked at again, so the time is linear in the text.

Kinds, in their order: email, ip, card, phone (base) and url (with user data before its host), account (IBAN or an
account or social security number after its cue), secret (the value after a credential's cue).  Spans are code point
offsets, end exclusive; spans of different kinds may overlap, those of one kind don't.

Rows are independent (one narrow Arrow stage; nothing is shuffled).  Defined results: NULL and empty texts have no
spans (a masked NULL stays NULL); repeated rows give repeated results; other columns pass through; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.llm.common import fresh

#: The kinds in output order, base kinds first.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]
SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                       T.StructField("end", T.IntegerType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: Texts of an Arrow batch that are Python strings at a time.
ROWS = 256

#: Cue words of credentials and of account numbers.
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "private_key")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER_RUN = re.compile(r"[0-9 ().+\-]+")
# a run of digits is taken whole, so a start inside one can be passed over
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#\"'<>@]+@[A-Za-z0-9.-]+[^\s\"'<>]*")
_VALUE = re.compile(r"[\"']?\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9+/_.~-]{12,})")
_ACCOUNT = re.compile(r"[^A-Za-z0-9\n]{0,4}(?:(?i:no|nr|number)[^A-Za-z0-9\n]{0,4})?"
                      r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{8,17}(?![0-9]))")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _numbers(text: str, lo: int, hi: int, out: list) -> None:
    """ip, card and phone matches in a maximal run of number characters."""
    for m in _IP.finditer(text, lo, hi):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text, lo, hi):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text, lo, hi):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # end of the last span of a kind, or of what was searched for it
    number_end = 0
    for last, (anchor, size) in _anchors().iter(text or ""):
        end = last + 1
        if anchor == "digit":
            if last >= number_end:
                number_end = _NUMBER_RUN.match(text, last).end()
                _numbers(text, last - (last > 0 and text[last - 1] == "+"), number_end, out)
        elif anchor == "at":
            start = last
            while start > done[0] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, end)):
                out.append((start, 0, m.end()))
                done[0] = m.end()
        elif anchor == "scheme":
            start = end - size
            while start > done[4] and text[start - 1] in _SCHEME:
                start -= 1
            if start < end - size and (m := _USERINFO.match(text, end)):
                out.append((start, 4, m.end()))
                done[4] = m.end()
        elif anchor == "secret":
            if end > done[6] and (m := _VALUE.match(text, end)):
                out.append((m.start(1), 6, m.end(1)))
                done[6] = m.end(1)
        elif end > done[5] and (m := _ACCOUNT.match(text, end)):
            if not m.group(1)[:1].isalpha() or _iban(m.group(1)):
                out.append((m.start(1), 5, m.end(1)))
                done[5] = m.end(1)
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def mask(text: str | None) -> str | None:
    """The text with every span (overlapping ones as one, named by the first) replaced by [KIND]."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _each(texts: pa.Array, function, kind: pa.DataType) -> pa.Array:
    """``function`` of every text; only ``ROWS`` texts and results at a time are Python objects, never a whole batch."""
    parts = [pa.array([function(t.as_py()) for t in texts.slice(lo, ROWS)], kind) for lo in range(0, len(texts), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(SPANS_TYPE)
def pii_spans(texts: pa.Array) -> pa.Array:
    """Column function: the spans of each text."""
    return _each(texts, lambda t: [dict(zip(("kind", "start", "end"), span)) for span in find_spans(t)], SPANS_ARROW)


@F.arrow_udf(T.StringType())
def mask_pii(texts: pa.Array) -> pa.Array:
    """Column function: each text with its personal data masked."""
    return _each(texts, mask, pa.string())


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the spans of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col)).alias("found"))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` (all columns, in their order) with personal data masked in ``text_col``; ``count_col``, if there:
    the code points of the masked text."""
    masked, = fresh(docs, "masked_text")
    out = docs.withColumn(masked, mask_pii(F.col(text_col)))
    counted = F.length(F.col(masked)).cast(docs.schema[count_col].dataType) if count_col in docs.columns else None
    value = {text_col: F.col(masked)} | ({count_col: counted} if counted is not None else {})
    return out.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in docs.columns])
