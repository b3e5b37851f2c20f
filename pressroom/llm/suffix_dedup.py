"""Exact substring deduplication over all documents by sorting sparse suffixes.

A byte goes when it lies in a ``LENGTH``-byte string that also starts in a document with a smaller id.  Instead of
every suffix only *anchored* ones are sorted: in each window of ``LENGTH`` bytes the ``GRAM``-byte gram with the
least hash is its anchor (the leftmost of equals), so equal windows have the same anchor at the same place, and a
window is looked up through the suffix that starts at its anchor.  About one position in sixteen is one.

1. Each document emits its anchored suffixes: leading bytes, hashes of what its windows cover, place.
2. Splitters sampled from the suffixes deal them out by their leading bytes into ranges.  Each bucket is sorted by
   multikey quicksort (key by key, only ties go on to the next key) and neighbours are compared: suffixes whose
   whole cover is the same form a run, of which all but the smallest id lose all windows of the suffix.  Where covers
   differ but leading bytes and one side agree, windows may still be shared in part: those suffixes go on to step 3.
3. Of these the covers are read from the texts, dealt out by their leading gram and compared window by window.
A leading key too large for one bucket is dealt over several by a hash of the id; what a bucket then can't see is
decided in step 3, and a gram with too many covers there has its windows dealt out one by one (aggregated by window
before any shuffle), so no task gets an unbounded group and nothing is skipped.

Equality of covers and windows is that of 50 and 128 bit hashes on top of equal leading bytes.  Intermediate rows are
written to the shared folder; only the splitters (a sample) and counts reach the driver.

Defined results: NULL is an empty text; texts under ``LENGTH`` bytes lose nothing; a row with a NULL id neither
removes nor loses anything; rows that repeat an id are documents of the same rank (they don't remove from each
other), each with its own result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import small_side
from pressroom.session import scratch_path

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1            # grams in a window
SIDE = (LENGTH - GRAM) // 2         # bytes beside the gram that a window has at least on one side
#: Suffixes in a bucket, about, and sampled suffixes per bucket for the splitters.
BUCKET, SAMPLES = 1_000_000, 40
#: Covers of one gram that a task compares at once; beyond it the gram's windows are dealt out.
GROUP = 4_000
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PIECE = 1 << 23                    # positions that are handled at a time; must stay below the 24 bits used for them
_ROWS = 1 << 16


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MUL[salt % 3]
    return x ^ (x >> np.uint64(32))


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and the 4 bytes from each position as numbers that sort like the bytes."""
    x = b.astype(np.uint64)
    x2 = (x[:-1] << np.uint64(8)) | x[1:]
    x4 = (x2[:-2] << np.uint64(16)) | x2[2:]
    return (x4[:-4] << np.uint64(32)) | x4[4:], x4


def _piece_suffixes(b: np.ndarray, first: int, last: int):
    """(anchor, lo, hi, lead, key) for windows that start in [first, last); positions within ``b``."""
    x8, x4 = _words(b)
    m = len(b) - GRAM + 1
    g = _mix(x8[:m], 0)
    g = _mix(g + x8[8:8 + m], 1)
    g = _mix(g + x4[16:16 + m], 2)
    least = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[:size - SPAN], least[SPAN - size:])
    at = (least[first:last] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.append(0, cut)
    hi = np.append(cut, len(at)) - 1
    a = at[lo]
    pad = np.concatenate([x8, np.zeros(LENGTH, np.uint64)])
    right = np.where(a + GRAM + SIDE <= len(b), _mix(_mix(pad[a + GRAM], 0) + pad[a + GRAM + SIDE - 8], 1) | np.uint64(1),
                     np.uint64(0))
    left = np.where(a >= SIDE, _mix(_mix(pad[a - SIDE], 0) + pad[np.maximum(a - 8, 0)], 1) | np.uint64(1), np.uint64(0))
    return a, lo + first, hi + first, x8[a], g[a], right, left


def suffixes(text: bytes) -> np.ndarray:
    """The anchored suffixes: rows of (leading 8 bytes, gram and sides and place, cover and extent), unsigned.

    Column 1: 20 bits of the gram's hash, 10 each of what follows and precedes it, the low 24 bits of lo.
    Column 2: 50 bits of the hash of the cover text[lo:hi + LENGTH], 6 bits hi - lo, the high 8 bits of lo."""
    out = []
    n = len(text) - LENGTH + 1
    for begin in range(0, n, _PIECE):
        end = min(begin + _PIECE, n)
        # a window's anchor is decided inside the window, but its sides may reach beyond
        start, stop = max(begin - LENGTH, 0), min(end + 2 * LENGTH, len(text))
        b = np.frombuffer(text, np.uint8, stop - start, start)
        _, lo, hi, lead, g, right, left = _piece_suffixes(b, begin - start, end - start)
        lo, hi = lo + start, hi + start
        if hi[-1] >> 32:
            raise ValueError("texts of 4 GiB and more are not supported")
        cover = np.array([xxhash.xxh3_64_intdigest(text[i:j + LENGTH]) for i, j in zip(lo.tolist(), hi.tolist())],
                         np.uint64)
        u, s = lo.astype(np.uint64), np.uint64
        c1 = (g >> s(44) << s(44)) | (right >> s(54) << s(34)) | (left >> s(54) << s(24)) | (u & s(0xFFFFFF))
        c2 = (cover >> s(14) << s(14)) | ((hi - lo).astype(np.uint64) << s(8)) | (u >> s(24))
        out.append(np.stack([lead, c1, c2], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.uint64)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys: quicksort by the first, and only where it ties by the next, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    same = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        if not same.any():
            break
        tied = np.append(same, False) | np.append(False, same)
        at = np.flatnonzero(tied)
        group = np.cumsum(~np.append(False, same)[at])
        by = np.lexsort((key[order[at]], group))
        order[at] = order[at][by]
        k = key[order]
        same &= k[1:] == k[:-1]
    return order


def _shared(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows whose (group, value) another row has too; value 0 counts as none."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
    out = np.zeros(len(g), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out


def compare_bucket(lead, c1, c2, doc, rank, whole: np.ndarray):
    """(rows that lose all their windows, rows to be compared window by window) of one bucket.  ``rank``: what ids
    are compared by; ``whole``: rows whose leading key lies in this bucket alone."""
    s = np.uint64
    gram, cover = c1 >> s(44), c2 >> s(8)
    order = multikey_order([lead, gram, cover, rank])
    lead, gram, cover, rank, whole = (x[order] for x in (lead, gram, cover, rank, whole))
    sides = [(c1[order] >> s(34)) & s(0x3FF), (c1[order] >> s(24)) & s(0x3FF)]
    new_group = np.append(True, (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1]))
    new_run = new_group | np.append(True, cover[1:] != cover[:-1])
    group, run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
    least = rank[new_run][run]
    lost = rank > least
    first = np.flatnonzero(new_run)
    partial = np.zeros(len(run), bool)
    for side in sides:
        # a side of 0 bits left is as good as any: it only sends a row on to be compared
        partial[first] |= _shared(group[first], side[first] + s(1))
    partial = partial[first][run] | ~whole
    return order[lost], order[partial & ~lost]


def _text(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc, text) and the number of low bits of ``doc`` that tell rows with the same id apart."""
    read = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = read.filter("doc IS NOT NULL")
    most = known.groupBy("doc").count().agg(F.max("count")).first()[0] or 1
    bits = (most - 1).bit_length()
    if bits:  # repeated ids: number them (the few rows per id are bounded by their count)
        w = Window.partitionBy("doc").orderBy(F.xxhash64("text"))
        part = F.row_number().over(w) - 1
        numbered = known.withColumn("doc", F.shiftleft("doc", bits).bitwiseOR(part.cast("long")))
        read = numbered.unionByName(read.filter("doc IS NULL"))
    return read, bits


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed_spans(read: DataFrame, bits: int) -> DataFrame:
    """(doc, starts, ends): per document the byte runs that go, ascending and apart."""
    known = read.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * BUCKET)))

    def leads(batches):
        for batch in batches:
            for text in batch.column(0):
                keys = suffixes(text.as_py().encode())[:, 0]
                keys = keys[_mix(keys + np.arange(len(keys), dtype=np.uint64), 2) % np.uint64(8) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["lead"])
    share = min(1.0, n * SAMPLES * 8 * 16 / max(total, 1))
    sample = np.array([r.lead for r in known.select("text").sample(fraction=share, seed=3)
                       .mapInArrow(leads, "lead long").collect()], np.int64).view(np.uint64)
    sample.sort()
    cuts = sample[(np.arange(1, n) * len(sample)) // n] if len(sample) else np.zeros(0, np.uint64)

    def deal(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            parts, size = [], 0
            for k, (doc, text) in enumerate(zip(ids, texts)):
                rows = suffixes(text.as_py().encode())
                parts.append((rows, np.full(len(rows), doc, np.int64)))
                size += len(rows)
                if parts and (size >= _ROWS or k == len(ids) - 1):
                    rows, docs = (np.concatenate(x) for x in zip(*parts))
                    low = np.searchsorted(cuts, rows[:, 0], "left")
                    high = np.searchsorted(cuts, rows[:, 0], "right")
                    wide = (high - low + (low != high)).astype(np.int64)  # buckets that this key is dealt over
                    salt = _mix(docs.view(np.uint64), 1) % np.maximum(wide, 1).astype(np.uint64)
                    bucket = low + np.where(low != high, salt.astype(np.int64), 0)
                    cols = [bucket.astype(np.int32), *(rows[:, j].copy().view(np.int64) for j in range(3)), docs,
                            low == high]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                    parts, size = [], 0
    names = ["bucket", "lead", "c1", "c2", "doc", "whole"]
    kind = "bucket int, lead long, c1 long, c2 long, doc long, whole boolean"

    def compare(batches):
        got = [[], [], [], [], []]
        for batch in batches:
            for col, x in zip(got, batch.columns[:4]):
                col.append(x.to_numpy())
            got[4].append(batch.column(4).to_numpy(zero_copy_only=False))
        if not got[0]:
            return
        lead, c1, c2, doc, whole = (np.concatenate(x) for x in got)
        lead, c1, c2 = lead.view(np.uint64), c1.view(np.uint64), c2.view(np.uint64)
        lo = (c1 & np.uint64(0xFFFFFF)) | ((c2 & np.uint64(0xFF)) << np.uint64(24))
        extent = (c2 >> np.uint64(8)) & np.uint64(63)
        gram = (_mix(lead, 0) ^ (c1 >> np.uint64(44))).view(np.int64)
        for part, rows in enumerate(compare_bucket(lead, c1, c2, doc, doc >> bits, whole)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[rows]), pa.array(lo[rows].astype(np.int64)), pa.array(extent[rows].astype(np.int32)),
                 pa.array(gram[rows] if part else np.zeros(len(rows), np.int64)),
                 pa.array(np.full(len(rows), part == 1))], ["doc", "lo", "extent", "gram", "partial"])
    dealt = known.mapInArrow(deal, kind).repartitionById(n, F.col("bucket")).drop("bucket")
    found = _written(dealt.mapInArrow(compare, "doc long, lo long, extent int, gram long, partial boolean"), "suffix-runs")

    # step 3: covers of the suffixes that share windows in part
    places = found.filter("partial").groupBy("doc").agg(F.collect_list(F.struct("lo", "extent", "gram")).alias("places"))
    places = places.withColumnRenamed("doc", "at")

    def covers(batches):
        for batch in batches:
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                b = text.as_py().encode()
                lo = [p["lo"] for p in found]
                cover = [b[p["lo"]:p["lo"] + p["extent"] + LENGTH] for p in found]
                gram = [p["gram"] for p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(lo), pa.int64()), pa.array(lo, pa.int64()), pa.array(gram, pa.int64()),
                     pa.array(cover, pa.binary())], ["doc", "lo", "gram", "cover"])
    # the places grow with the input, so this join shuffles the texts that have some
    covered = _written(known.join(places, F.col("doc") == F.col("at")).select("doc", "text", "places")
                       .mapInArrow(covers, "doc long, lo long, gram long, cover binary"), "suffix-covers")
    large = _written(covered.groupBy("gram").count().filter(F.col("count") > GROUP)
                     .select(F.col("gram").alias("large_gram")), "suffix-large")
    here = covered.join(small_side(large, 16), F.col("gram") == F.col("large_gram"), "left_anti")
    apart = covered.join(small_side(large, 16), F.col("gram") == F.col("large_gram"), "left_semi")

    def windows(batches):
        # sorted by gram: whole grams are compared together, one piece of rows after the other
        held: list = []
        for batch in batches:
            rows = list(zip(*(batch.column(j).to_pylist() for j in range(4))))
            if rows:
                held += rows
                last = rows[-1][2]
                if len(held) >= GROUP and held[0][2] != last:
                    yield _compare_windows([r for r in held if r[2] != last], bits)
                    held = [r for r in held if r[2] == last]
        if held:
            yield _compare_windows(held, bits)
    span = "doc long, start long, end long"
    local = (here.repartition("gram").sortWithinPartitions("gram").mapInArrow(windows, span))

    def explode(batches):
        for batch in batches:
            for doc, lo, _, cover in zip(*(batch.column(j).to_pylist() for j in range(4))):
                h = _window_hashes(cover)
                k = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * k, pa.int64()), pa.array(np.arange(lo, lo + k)), pa.array(h[:, 0].copy()),
                     pa.array(h[:, 1].copy())], ["doc", "start", "h0", "h1"])
    each = apart.mapInArrow(explode, "doc long, start long, h0 long, h1 long")
    rank = F.shiftright("doc", bits)
    least = each.groupBy("h0", "h1").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).filter("least < most")
    least = _written(least.drop("most"), "suffix-windows")
    spread = each.join(least, ["h0", "h1"]).filter(rank > F.col("least")).select(
        "doc", "start", (F.col("start") + LENGTH).alias("end"))
    whole = found.filter("NOT partial").select("doc", F.col("lo").alias("start"),
                                               (F.col("lo") + F.col("extent") + LENGTH).alias("end"))

    def join_up(batches):
        doc, run, starts, ends = None, None, [], []
        done: list = []
        for batch in batches:
            for d, s, e in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if d != doc:
                    if doc is not None:
                        done.append((doc, starts + [run[0]], ends + [run[1]]))
                    doc, run, starts, ends = d, [s, e], [], []
                elif s <= run[1]:
                    run[1] = max(run[1], e)
                else:
                    starts.append(run[0])
                    ends.append(run[1])
                    run = [s, e]
            if len(done) >= 1000:
                yield _span_rows(done)
                done = []
        if doc is not None:
            done.append((doc, starts + [run[0]], ends + [run[1]]))
            yield _span_rows(done)
    every = whole.unionByName(local).unionByName(spread)
    return _written(every.repartition("doc").sortWithinPartitions("doc", "start")
                    .mapInArrow(join_up, "doc long, starts array<long>, ends array<long>"), "suffix-spans")


def _span_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                                       pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc", "starts", "ends"])


def _window_hashes(cover: bytes) -> np.ndarray:
    """128 bits of each window, as two signed numbers."""
    raw = b"".join([xxhash.xxh3_128_digest(cover[i:i + LENGTH]) for i in range(len(cover) - LENGTH + 1)])
    return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)


def _compare_windows(rows: list, bits: int) -> pa.RecordBatch:
    """The windows of covers with the same gram that a smaller id has too, as (doc, start, end) rows."""
    hashes = [_window_hashes(r[3]) for r in rows]
    sizes = [len(h) for h in hashes]
    h = np.concatenate(hashes)
    doc = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
    start = np.concatenate([np.arange(r[1], r[1] + k) for r, k in zip(rows, sizes)])
    order = multikey_order([h[:, 0], h[:, 1], doc >> bits])
    h, doc, start = h[order], doc[order], start[order]
    new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
    least = (doc >> bits)[new][np.cumsum(new) - 1]
    out = (doc >> bits) > least
    return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out]), pa.array(start[out] + LENGTH)],
                                      ["doc", "start", "end"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``keep_text`` also ``kept``, the bytes
    that remain."""
    read, bits = _text(docs, id_col, text_col)
    spans = removed_spans(read, bits)
    size = spans.agg(F.sum(F.size("starts"))).first()[0] or 0
    side = spans.withColumnRenamed("doc", "at")
    if size * 16 + spans.count() * 40 <= 64 << 20:
        side = F.broadcast(side)

    def cut(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc, text, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1),
                                               batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                b, at, sha, gone, kept = text.as_py().encode(), 0, hashlib.sha256(), 0, []
                for s, e in zip(starts or [], ends or []):
                    sha.update(b[at:s])
                    kept.append(b[at:s])
                    gone += e - s
                    at = e
                sha.update(b[at:])
                kept.append(b[at:])
                values = (None if doc is None else doc >> bits, len(b), gone, len(starts or []), sha.hexdigest(),
                          b"".join(kept) if keep_text else None)
                for col, x in zip(out, values):
                    col.append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)][:5 + keep_text],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][
                                                 :5 + keep_text])
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return (read.join(side, F.col("doc") == F.col("at"), "left").select("doc", "text", "starts", "ends")
            .mapInArrow(cut, kind))
