"""Extraction stage (E1-E6): page HTML -> candidate article records.

One ``mapInArrow`` stage: ``(page_id, profile, source, base_url, url, html)`` in,
``(page_id, source, base_url, pos, title, perex, url, error)`` out.  Pages are
independent, so the stage needs no shuffle: it runs wherever the page split is read.
A task holds one parsed page, the strings of about ``IN_BYTES`` of pages and about ``OUT_CHARS`` of found texts at a
time, beside the Arrow batch it reads (whose bytes Spark limits).  Profiles travel in the task closure (driver-side
registry, bounded by the number of sources) and selectors are compiled once per task.

Per page (as the reference does per source page):
1. containers: each container selector in turn, document order within a selector,
   first occurrence of each element kept (E1); a run with ``use_cap`` uses only the
   first ``cap`` and reports the others as rejects (E2);
2. title: for each title selector test only its first match; accept when the cleaned
   text has >= 10 characters, else try the next selector (E3);
3. perex: the same with >= 20 characters, else '' (E4);
4. url: the first url selector whose first match has a non-empty href (E5); with
   ``url_fallback_to_page`` the page url when none has;
5. no title or no url -> the element is skipped; an exception -> an ``error`` row
   (quarantined by the caller), never a failed job (E6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------------------
MIN_TITLE_CHARS = 10
MIN_PEREX_CHARS = 20
# ---------------------------------------------------------------------------------------
IN_BYTES = 2_000_000    # pages of a read batch that become Python strings at a time (one page at least)
OUT_CHARS = 4_000_000   # a task hands on its rows when their texts add up to this
FOUND_BY = "found_by"   # names of the profiles that found a candidate (pages with several profiles)
OVER_CAP = "over_cap"   # marks a candidate that a capped run leaves out

RAW_SCHEMA = T.StructType([
    T.StructField("page_id", T.StringType()),   # text: integers with NULLs would become floats
    T.StructField("source", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("perex", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("error", T.StringType()),
])

PAGE_COLUMNS = ["page_id", "profile", "source", "base_url", "url", "html"]


def _compile(profile):
    from pressroom.operators.htmltree import compile_selector
    c = lambda lst: [compile_selector(s) for s in lst]
    return (c(profile.containers), c(profile.title), c(profile.perex), c(profile.url))


def _first_text(doc, el, matchers, min_chars):
    from pressroom.operators.htmltree import select_one
    for m in matchers:
        hit = select_one(doc, el, m)
        if hit is not None:
            t = doc.clean_text_of(hit)
            if t and len(t) >= min_chars:
                return t
    return ""


def _first_href(doc, el, matchers):
    from pressroom.operators.htmltree import select_one
    for m in matchers:
        hit = select_one(doc, el, m)
        if hit is not None and hit.get("href"):
            return hit.get("href")
    return ""


def extract_page(html: str, profile, compiled, page_url: str | None = None, extractor=None, use_cap: bool = False,
                 doc=None):
    """Candidates of one page as ``(pos, title, perex, url, error)`` tuples; ``doc``: the page if already parsed."""
    from pressroom.operators.htmltree import Document, select
    if extractor is not None:  # E9 plug-in: a custom per-page extractor
        return [(i, r.get("title", ""), r.get("perex", ""), r.get("url", ""), None)
                for i, r in enumerate(extractor(html))]
    doc = Document(html) if doc is None else doc
    cont, tsel, psel, usel = compiled
    # elements by their position on the page, in the order in which a selector first finds them
    elements = {e.start: e for m in cont for e in select(doc, doc.root, m)}
    out = []
    for pos, el in enumerate(elements.values()):
        if use_cap and pos >= profile.cap:
            out.append((pos, None, None, None, OVER_CAP))
            continue
        try:
            title = _first_text(doc, el, tsel, MIN_TITLE_CHARS)
            if not title:
                continue
            perex = _first_text(doc, el, psel, MIN_PEREX_CHARS)
            url = _first_href(doc, el, usel)
            if not url and profile.url_fallback_to_page:
                url = page_url or ""
            if not url:
                continue
            out.append((pos, title, perex, url, None))
        except Exception as exc:  # noqa: BLE001 - isolate one bad element
            out.append((pos, None, None, None, f"{type(exc).__name__}: {exc}"))
    return out


def extract_with_each(html: str, names, profiles: dict, compiled: dict, page_url: str | None = None,
                      extractors: dict | None = None, use_cap: bool = False) -> dict:
    """Candidates of one page by each named profile: ``(pos, title, perex, url, error)`` -> the names that found it.
    The page is parsed once; a profile that fails leaves an error row (pos -1) and the others go on."""
    from pressroom.operators.htmltree import Document
    found: dict[tuple, list[str]] = {}
    doc = None
    for name in dict.fromkeys(names):
        try:
            prof, extractor = profiles[name], (extractors or {}).get(name)
            if name not in compiled:
                compiled[name] = _compile(prof)
            if doc is None and extractor is None:
                doc = Document(html)
            got = extract_page(html, prof, compiled[name], page_url, extractor, use_cap, doc)
        except Exception as exc:  # noqa: BLE001 - isolate one bad page
            got = [(-1, None, None, None, f"{type(exc).__name__}: {exc}")]
        for row in got:
            found.setdefault(row, []).append(name)
    if doc is not None:
        doc.release()
    return found


def _page_slices(batches):
    """Read batches as small pandas frames, in order: a whole batch never becomes Python strings."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < len(ends):
            until = IN_BYTES + (ends[lo - 1] if lo else 0)
            hi = max(lo + 1, int(np.searchsorted(ends, until, "right")))
            yield batch.slice(lo, hi - lo).to_pandas(integer_object_nulls=True)
            lo = hi
        del batch, sizes, ends  # not held while the next one is read
        pa.default_memory_pool().release_unused()


def _arrow_stage(stage, schema: T.StructType):
    """``stage`` (pandas frames in and out) over Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        for out in stage(_page_slices(batches)):
            yield pa.RecordBatch.from_pandas(out, types, preserve_index=False)
    return run


def _make_stage(profiles: dict, extractors: dict | None = None, carry=(), several=False, use_cap=False):
    carry = list(carry)
    names = RAW_SCHEMA.fieldNames() + ([FOUND_BY] if several else [])

    def stage(batches):
        import pandas as pd
        compiled = {}

        def emit(pdf, rows, at):
            out = pd.DataFrame(rows, columns=names).astype({"pos": "int32"})
            for c in carry:  # page-level columns handed through, no re-join on page_id later
                out[c] = pdf[c].iloc[at].reset_index(drop=True)
            return out

        for pdf in batches:
            rows, at, size = [], [], 0
            for i, (page_id, by, source, base_url, url, html) in enumerate(zip(*[pdf[c] for c in PAGE_COLUMNS])):
                if several:
                    by = [None] if by is None or len(by) == 0 else by
                else:
                    by = [by]
                if page_id is None:
                    found = {(-1, None, None, None, "ValueError: page without an id"): list(by)}
                else:
                    found = extract_with_each(html, by, profiles, compiled, url, extractors, use_cap)
                for (pos, title, perex, u, err), who in found.items():
                    rows.append((page_id, source, base_url, pos, title, perex, u, err) + ((who,) if several else ()))
                    at.append(i)
                    size += len(title or "") + len(perex or "")
                    if size >= OUT_CHARS:
                        yield emit(pdf, rows, at)
                        rows, at, size = [], [], 0
            if rows:
                yield emit(pdf, rows, at)
    return stage


def extract_raw(pages: DataFrame, profiles: dict | None = None, extractors: dict | None = None,
                carry=(), use_cap: bool = False) -> DataFrame:
    """Run the extraction stage; ``pages`` needs PAGE_COLUMNS.  Where ``profile`` is an array of names, each page is parsed
    once for all of them, and a candidate that several find with the same values is one row with their names in
    ``found_by``: explode it after the costly columns."""
    from pressroom.sources.profiles import registry
    profiles = profiles or registry()
    carry = [c for c in carry if c not in PAGE_COLUMNS and c != FOUND_BY]
    several = isinstance(pages.schema["profile"].dataType, T.ArrayType)
    by = [T.StructField(FOUND_BY, T.ArrayType(T.StringType()))] if several else []
    schema = T.StructType(RAW_SCHEMA.fields + by + [pages.schema[c] for c in carry])
    read = pages.select(*PAGE_COLUMNS, *carry).withColumn("page_id", F.col("page_id").cast("string"))
    out = read.mapInArrow(_arrow_stage(_make_stage(profiles, extractors, carry, several, use_cap), schema), schema)
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def extract_articles(pages: DataFrame, profiles: dict | None = None, extractors: dict | None = None,
                     errors: str = "quarantine", carry=(), use_cap: bool = False):
    """E1-E6 + F1 + F6: pages -> (articles, rejects, quarantine).

    ``articles`` carry page_id, pos, title, perex, source, url, title_hash; the
    validity gate and keying run JVM-side on the stage output."""
    raw = extract_raw(pages, profiles, extractors, carry, use_cap)
    return split_raw(raw, errors, carry)


def split_raw(raw: DataFrame, errors: str = "quarantine", carry=()):
    """The stage output as (articles, rejects, quarantine)."""
    from pressroom.operators.articles import to_articles, validate_articles
    cut = raw.filter(F.col("error") == OVER_CAP)
    quarantine = raw.filter(F.col("error").isNotNull() & (F.col("error") != OVER_CAP)).select("page_id", "source", "pos", "error")
    if errors == "raise":
        # materialise errors eagerly only when the caller asks the job to fail on them
        first = quarantine.limit(1).collect()
        if first:
            raise RuntimeError(f"extraction failed: {first[0]['error']}")
    good = raw.filter(F.col("error").isNull())
    by = [FOUND_BY] if FOUND_BY in raw.columns else []
    valid, rejects = validate_articles(good, base_url="base_url", keep=["page_id", "pos", *by, *carry])
    over = cut.select(*[F.col(c) if c in cut.columns else F.lit(None).cast(rejects.schema[c].dataType).alias(c)
                        for c in rejects.columns if c != "reason"], F.lit(OVER_CAP).alias("reason"))
    return to_articles(valid), rejects.unionByName(over), quarantine
