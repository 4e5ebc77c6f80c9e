"""Suffix-array dedup: every byte that a LENGTH-byte string covers which also starts anywhere else is removed.

Method: threshold-bounded interval expansion. Candidate text is sorted into a
Burrows-Wheeler transform; starting from the empty string's interval, every
interval is extended backwards by one symbol, breadth first. The level at which
a border between neighbouring suffixes first shows up is the length of their
common prefix, so common prefixes come out by increasing value, and the
expansion stops at LENGTH: borders that are still unset divide suffixes which
share LENGTH bytes or more.

At scale one transform of the whole corpus has no place, and most text needs
none. A window of LENGTH bytes is represented by its least K-gram, its anchor
(anchors.py): equal windows have equal anchors, so windows of an anchor that
occurs once are unique. Occurrences with equal segments (the text of all the
windows that an anchor stands for, told apart by digests of 128 bits) repeat as a
whole. Windows of anchors with several different segments are decided by the
transform: one copy of each segment goes to a batch of about BATCH_BYTES by its
group, and the batches are expanded independently.

A group of more than GROUP_SEGMENTS segments is narrowed first. Its segments are cut at
fixed distances between window and anchor (WIDTHS, halved from step to step), and
the parts are grouped anew by their core, the bytes that all windows of such a
part hold: equal windows have equal cores, so they stay together. A segment has
mostly one part whose core it shares with others, however many steps it takes;
equal parts become one. At the last width a part is one window, and
its core the window itself: no group is left that is too large.

Defined cases: null text is empty; matches never cross documents; overlaps
count; strings are judged on the input. Rows with equal doc_id and text repeat
each other. A null doc_id is an id like any other. Very long texts are read in
pieces that overlap by LENGTH - 1 bytes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchored, covered
from .common import SLICE_BYTES, as_long, batch_of, byte_grams, cleanup, conf_text_batches, digests, keyed, longs, ranges, real_id, settle, slices, table
from .repeats import ANCHORS, ANCHORS_SQL, matched, per_document, repeated, span_lists

LENGTH = 200
K = 24
BATCH_BYTES = 1 << 20
GROUP_SEGMENTS = 500
WIDTHS = (88, 44, 22, 11, 5, 2, 1)
#: Ends every segment in a transform; no UTF-8 text has this byte.
END = 255


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols at least: eight symbols first, then doubling for those that still tie."""
    n = len(s)
    padded = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)  # 1 and up; 0 stands behind the end
    rank[order] = np.repeat(first, np.diff(np.append(first, n))) + 1
    rank[n] = 0
    h = 8
    while h < depth:
        single = new.copy()
        single[:-1] &= new[1:]
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        at = order[tied]
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n)].astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        order[tied] = at[by]
        new[tied[1:]] |= pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new[tied]) - 1
        rank[order[tied]] = tied[np.flatnonzero(new[tied])][group] + 1
        h *= 2
    return order


def shares_prefix(s: np.ndarray, depth: int) -> np.ndarray:
    """For each place: do the `depth` symbols from there, all before the next END, also start elsewhere in s?

    Breadth-first backward extension: an interval [lb, rb) of the suffix order
    holds the suffixes with one prefix; extending it by a symbol c in front gives
    the interval of the LF-mapped rows with c in the transform.
    """
    n = len(s)
    order = suffix_order(s, depth)
    bwt = s[order - 1]
    lf_order = np.argsort(bwt, kind="stable")  # row of the transform by row of the first column
    lf = np.empty(n, np.int64)
    lf[lf_order] = np.arange(n)
    unset = np.ones(n + 1, bool)  # borders below each row
    unset[[0, n]] = False
    lb, rb = np.array([0]), np.array([n])
    for _ in range(depth):
        size = rb - lb
        rows, owner_lb, owner_rb = ranges(lb, size), np.repeat(lb, size), np.repeat(rb, size)
        keep = bwt[rows] != END
        rows, owner_lb, owner_rb = rows[keep], owner_lb[keep], owner_rb[keep]
        to, symbol = lf[rows], bwt[rows]
        # a row is the last (first) of its symbol in the interval, if the next (previous) row of that symbol lies outside
        after, before = lf_order[np.minimum(to + 1, n - 1)], lf_order[np.maximum(to - 1, 0)]
        last = (to + 1 >= n) | (bwt[after] != symbol) | (after >= owner_rb)
        first = (to == 0) | (bwt[before] != symbol) | (before < owner_lb)
        new_lb, new_rb = np.sort(to[first]), np.sort(to[last]) + 1
        fresh = unset[new_rb]
        lb, rb = new_lb[fresh], new_rb[fresh]
        unset[rb] = False
        if not len(lb):
            break
    out = np.zeros(n, bool)
    out[order] = unset[:-1] | unset[1:]
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text", 1 << 18):
        k, h = longs(batch, "k"), longs(batch, "h")
        step = SLICE_BYTES if len(offs) == 2 else len(data) or 1  # a long document goes in pieces
        for a in range(0, len(data), step):
            part = data[a : a + step + LENGTH - 1]
            row, lo, n, shift, anchor = anchored(byte_grams(part, K, 3), offs if step >= len(data) else np.array([0, len(part)]), LENGTH, K)
            raw = part.tobytes()
            s1, s2 = digests(raw[x : x + m] for x, m in zip(lo.tolist(), (n + LENGTH - 1).tolist(), strict=True))
            yield batch_of(ANCHORS, as_long(anchor), s1, s2, k[row], h[row], lo + a - offs[row], n, shift)


#: g: the group whose windows may be equal. single: no other occurrence of the whole segment.
SEGMENTS = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("shift", pa.int64()), ("single", pa.bool_()), ("body", pa.binary())])
SEGMENTS_SQL = "g long, k long, h long, lo long, n long, shift long, single boolean, body binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        row, anchor, lo, n, shift, single = span_lists(batch, "spans", "anchor", "lo", "n", "shift", "single")
        raw, at, k, h = data.tobytes(), offs[row] + lo, longs(batch, "k"), longs(batch, "h")
        for a in range(0, len(row), 10_000):
            b = slice(a, a + 10_000)
            body = [raw[x : x + m] for x, m in zip(at[b].tolist(), (n[b] + LENGTH - 1).tolist(), strict=True)]
            yield batch_of(SEGMENTS, anchor[b], k[row[b]], h[row[b]], lo[b], n[b], shift[b], single[b].astype(bool), body)


CUT = pa.schema([*SEGMENTS, ("s1", pa.int64()), ("s2", pa.int64())])
CUT_SQL = SEGMENTS_SQL + ", s1 long, s2 long"


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The segments' parts, cut where the distance of window and anchor is a multiple of width, by core."""
    for batch in batches:
        out = []
        for g, k, h, lo, n, shift, single, body in zip(*[c.to_pylist() for c in batch.select(SEGMENTS.names).columns], strict=True):
            for cell in range((shift - n + 1) // width, shift // width + 1):
                near, far = cell * width, min((cell + 1) * width - 1, LENGTH - K)
                first, last = shift - min(far, shift), shift - max(near, shift - n + 1)
                core = b"%d %d " % (g, cell) + body[shift - near : shift - far + LENGTH]
                group = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                out.append((group, k, h, lo + first, last - first + 1, shift - first, single, body[first : last + LENGTH]))
        for a in range(0, len(out), 10_000):
            cols = [*zip(*out[a : a + 10_000], strict=True)]
            yield batch_of(CUT, *cols, *digests(cols[-1]))


SPANS = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
SPANS_SQL = "k long, h long, lo long, n long"


def _expand(group: pa.Table) -> pa.Table:
    """Windows of single segments that another segment of the batch holds too, as spans of window starts."""
    bodies = group["body"].combine_chunks()
    body = np.frombuffer(b"".join(b + b"\xff" for b in bodies.to_pylist()), np.uint8)
    n, lo = group["n"].to_numpy(), group["lo"].to_numpy()
    k, h, single = group["k"].to_numpy(), group["h"].to_numpy(), group["single"].to_numpy()
    start = np.cumsum(np.append(0, n + LENGTH))[:-1]
    found = shares_prefix(body, LENGTH)
    hit = found[ranges(start, n)] & np.repeat(single, n)
    own = np.repeat(np.arange(len(n)), n)
    edge = hit.copy()
    edge[1:] &= ~(hit[:-1] & (own[1:] == own[:-1]))
    stop = hit.copy()
    stop[:-1] &= ~(hit[1:] & (own[1:] == own[:-1]))
    a, z = np.flatnonzero(edge), np.flatnonzero(stop)
    begin = np.cumsum(np.append(0, n))[:-1]
    o = own[a]
    return pa.table([pa.array(k[o]), pa.array(h[o]), pa.array(lo[o] + a - begin[o]), pa.array(z - a + 1)], schema=SPANS)


def narrowed(segments: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """The segments in groups of at most GROUP_SEGMENTS different ones, their bytes, and the windows (k, h, lo, n) that turn out to be repeated on the way."""
    small, size, spans = None, 0, None
    for width in [None, *WIDTHS]:
        if width is not None:
            parts = settle(segments.mapInArrow(lambda it, width=width: _cut(it, width), CUT_SQL))
            one = F.min(F.struct("single", "k", "h", "lo", "n", "shift", "body"))  # one that is no single, if there is one
            kinds = settle(parts.groupBy("g", "s1", "s2").agg(F.count("*").alias("c"), one.alias("one")))
            more = matched(parts.where("single"), settle(kinds.where("c > 1").select("g", "s1", "s2", "c")), ["g", "s1", "s2"]).select(*SPANS.names)
            spans = more if spans is None else spans.unionByName(more)
            segments = kinds.select("g", "one.k", "one.h", "one.lo", "one.n", "one.shift", (F.col("one.single") & (F.col("c") == 1)).alias("single"), "one.body")
        groups = settle(segments.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.col("n") + LENGTH).alias("size"), (F.count("*") > GROUP_SEGMENTS).alias("wide")).where("c > 1"))
        own = matched(segments, groups.drop("size"), ["g"])
        fit = own.where("not wide").drop("wide")
        small = fit if small is None else small.unionByName(fit)
        wide, fits = groups.agg(F.count_if("wide"), F.sum(F.when(~F.col("wide"), F.col("size")))).head()
        size += fits or 0
        if not wide:
            break
        segments = settle(own.where("wide").drop("wide"))
    return small, size, spans


def repeated_spans(own: DataFrame) -> DataFrame:
    """k, h, lo, n: windows (bytes lo ... lo + n - 1 of the document are their starts) that also start elsewhere."""
    found = settle(repeated(own.mapInArrow(_anchors, ANCHORS_SQL)))
    spans, segment = SPANS.names, ["anchor", "s1", "s2"]
    several = found.where("several")
    segments = settle(several.groupBy(*segment).agg(F.count("*").alias("c"), F.min(F.struct(*spans, "shift")).alias("one")))
    copies = matched(several, settle(segments.where("c > 1").select(*segment, "c")), segment).select(*spans)

    fields = ["anchor", "lo", "n", "shift", "single"]
    needed = per_document(segments.select("one.k", "one.h", "anchor", "one.lo", "one.n", "one.shift", (F.col("c") == 1).alias("single")), *fields)
    bodies = settle(own.join(needed, ["k", "h"]).mapInArrow(_segments, SEGMENTS_SQL))
    small, size, on_the_way = narrowed(bodies)
    parts = -(-size // BATCH_BYTES) or 1
    expanded = small.withColumn("batch", F.pmod(F.xxhash64("g"), F.lit(parts))).groupBy("batch").applyInArrow(_expand, SPANS_SQL)
    out = found.where("not several").select(*spans).unionByName(copies).unionByName(expanded)
    return out if on_the_way is None else out.unionByName(on_the_way)


KEPT = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        row, lo, n = span_lists(batch, "spans", "lo", "n")
        gone = covered(offs[row] + lo, n + LENGTH - 1, len(data))
        removed = np.append(0, np.cumsum(gone))[offs]
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offs[(offs > 0) & (offs < len(data))]
        starts[inner] = gone[inner]
        n_spans = np.append(0, np.cumsum(starts))[offs]
        rest = data[~gone].tobytes()
        cut = (offs - removed).tolist()
        kept = [rest[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield batch_of(KEPT, longs(batch, "k"), np.diff(offs), np.diff(removed), np.diff(n_spans), kept)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k, n_bytes, n_removed, n_spans, kept (the remaining bytes): one row per document."""
    conf_text_batches(docs.sparkSession)
    own = keyed(docs, doc_id, text)
    with cleanup(docs.sparkSession):
        spans = settle(per_document(repeated_spans(own), "lo", "n"), keep=True)
    return own.join(spans, ["k", "h"], "left").mapInArrow(_kept, "k long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
