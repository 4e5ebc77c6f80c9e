"""Substring dedup by a log-structured fingerprint index: runs of historical window fingerprints, merge-joined with each new batch.

A word is removed, if a window of WINDOW words covers it whose word sequence
also starts earlier: in a smaller doc_id, or earlier in the same document.
Windows are judged on the input, not on what is left.

The index is a list of sorted, immutable runs: tables bucketed and sorted by
fingerprint. A batch of documents is fingerprinted and written as a run of its
own, which is then merge-joined with every run of history, without a new shuffle
of either; FAN_IN runs of a level are compacted into one run of the next.
Fingerprints are sparse: the least K-gram of words of a window, its
anchor, stands for all neighbouring windows that share it (anchors.py), and a
segment is the words of all those windows; equal windows have equal anchors.
With a path, an index outlives its session: a manifest there names the runs.

Verification: an equal anchor alone removes nothing. Segments are equal if the
digests (blake2b, 128 bits) of their words are. Where segments of an anchor
differ, the words of one copy of each are read again and their windows are
compared one by one, by digests too; the first start of each counts.

Defined cases: null text has no words. Rows with equal doc_id and text count as
one document, which never removes its own repetition; a null doc_id is the
smallest. Words are runs without the white space bytes 20 and 09-0D. Other
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchored, covered
from .common import as_long, batch_of, cleanup, conf_text_batches, delete, digests, grams, joined, keyed, longs, partitions, ranges, real_id, scratch, settle, slices, table, word_hashes, words
from .repeats import matched, per_document, span_lists

WINDOW = 20
K = 5
BATCHES = 3
FAN_IN = 2

#: Columns of hashes repeat nothing that a dictionary could hold.
HASHES = {"parquet.enable.dictionary": "false"}

#: A place in the corpus that orders as "earlier" does.
PLACE = "struct(k, h, lo)"
SEGMENT = ["anchor", "s1", "s2"]
SPANS = ["k", "h", "lo", "n"]

ANCHORS = pa.schema([(c, pa.int64()) for c in SEGMENT + SPANS])
ANCHORS_SQL = ", ".join(f"{c} long" for c in SEGMENT + SPANS)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text", 1 << 19):
        starts, ends, first = words(data, offs)
        row, lo, n, _, anchor = anchored(grams(word_hashes(data, starts, ends), K, 4), first, WINDOW, K)
        text, at = joined(data, starts, ends)
        s1, s2 = digests(text[a:b] for a, b in zip(at[lo].tolist(), at[lo + n - 1 + WINDOW].tolist(), strict=True))
        yield batch_of(ANCHORS, as_long(anchor), s1, s2, longs(batch, "k")[row], longs(batch, "h")[row], lo - first[row], n)


WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("own", pa.bool_())])
WINDOWS_SQL = "w1 long, w2 long, k long, h long, lo long, own boolean"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text", 1 << 19):
        starts, ends, first = words(data, offs)
        row, lo, n, own = span_lists(batch, "spans", "lo", "n", "own")
        at, which = np.unique(ranges(first[row] + lo, n), return_index=True)
        of, own = np.repeat(row, n)[which], np.repeat(own.astype(bool), n)[which]
        text, place = joined(data, starts, ends)
        w1, w2 = digests(text[a:b] for a, b in zip(place[at].tolist(), place[at + WINDOW].tolist(), strict=True))
        yield batch_of(WINDOWS, w1, w2, longs(batch, "k")[of], longs(batch, "h")[of], at - first[of], own)


class FingerprintIndex:
    """Runs of (anchor, s1, s2, c, k, h, lo, n): the first occurrence of each segment and their number in the run, in buckets by anchor and sorted by it.

    With a path the index is kept there: open() finds its runs again, in this or another session.
    """

    FIELDS = [*SEGMENT, "c", *SPANS]

    def __init__(self, spark: SparkSession, path: str | None = None):
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file: it is merged without another sort
        self.spark, self.path, self.kept, self.buckets = spark, path or scratch(spark), path is not None, partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.version = self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        out = cls(spark, path)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")) or []
        out.version = max((int(s.getPath().getParent().getName()) for s in done), default=0)
        if out.version:
            known = json.loads(spark.read.text(f"{path}/manifest/{out.version}").head()[0])
            out.levels, out.buckets = known["levels"], known["buckets"]
            columns = ", ".join(f"{c} BIGINT" for c in cls.FIELDS)
            for name in (n for level in out.levels for n in level):
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {out.buckets} BUCKETS LOCATION '{path}/{name}'")
        return out

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "anchor")

    def write(self, rows: DataFrame) -> str:
        """A new run of rows that have been dealt()."""
        name = f"run_{uuid.uuid4().hex}"
        rows.select(*self.FIELDS).write.format("parquet").option("parquet.enable.dictionary", "false").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return name

    def append(self, run: str) -> None:
        """Takes a written run in, compacts full levels, and drops what has been compacted when the new manifest stands."""
        self.levels[0].append(run)
        old: list[str] = []
        for level in range(len(self.levels)):
            if len(self.levels[level]) < FAN_IN:
                break
            every = self.spark.table(self.levels[level][0])
            for name in self.levels[level][1:]:
                every = every.unionByName(self.spark.table(name))
            first = F.min_by(F.struct(*SPANS), F.expr(PLACE)).alias("x")
            merged = self.dealt(every).groupBy(*SEGMENT).agg(F.sum("c").alias("c"), first).select(*SEGMENT, "c", "x.*")
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged))
            old += self.levels[level]
            self.levels[level] = []
            self.compactions += 1
        if self.kept:
            self.version += 1
            self.spark.createDataFrame([(json.dumps({"levels": self.levels, "buckets": self.buckets}),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version}")
        self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """An index without a path goes; of a kept one only the session's table names go."""
        for level in self.levels:
            if self.kept:
                for name in level:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                self._drop(level)
        self.levels = [[]]


def batches_of(docs: DataFrame, doc_id: str, n: int) -> list[tuple[Column, Column]]:
    """(batch, all up to its end) as conditions on docs: n batches by increasing doc_id, null first; equal ids stay together."""
    cuts = docs.select(F.percentile_approx(docs[doc_id].cast("long"), [i / n for i in range(1, n)], 1000)).head()[0] if n > 1 else None
    own, out, low = docs[doc_id].cast("long"), [], None
    for c in [*sorted(set(cuts or [])), None]:
        upto = F.lit(True) if c is None else own.isNull() | (own <= c)
        out.append((upto if low is None else (own > low) & upto, upto))
        low = c
    return out


def repeats_in(batch: DataFrame, index: FingerprintIndex, documents: DataFrame) -> DataFrame:
    """k, h, lo, n: windows of the batch that are in the index or start earlier in the batch; then the batch joins the index.

    documents: where the text of the index's entries is found, the batch's included.
    """
    with cleanup(batch.sparkSession):
        anchors = settle(batch.mapInArrow(_anchors, ANCHORS_SQL), **HASHES)
        kinds = anchors.groupBy(*SEGMENT).agg(F.count("*").alias("c"), F.min(F.expr(PLACE)).alias("p"), F.first("n").alias("n"))
        name = index.write(index.dealt(kinds.select(*SEGMENT, "c", "p.*", "n")))
        run = batch.sparkSession.table(name)
        mine = run.select(*FingerprintIndex.FIELDS, F.lit(True).alias("own"))
        past = None
        for old in index.runs():  # bucket by bucket: sorted runs are merged, nothing is dealt anew
            hits = old.join(run.select("anchor"), "anchor", "left_semi").select(*FingerprintIndex.FIELDS, F.lit(False).alias("own"))
            past = hits if past is None else past.unionByName(hits)
        # most anchors occur once, here and in history: their windows are unique
        again = run.groupBy("anchor").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where("c > 1")
        if past is None:
            touched = settle(again.select("anchor"))
            every = mine.join(touched, "anchor", "left_semi")
        else:
            past = settle(past)
            touched = settle(again.select("anchor").unionByName(past.select("anchor")).distinct())
            every = mine.join(touched, "anchor", "left_semi").unionByName(past)
        first, at = F.min(F.struct("own", "k", "h", "lo")).alias("first"), F.min(F.when(F.col("own"), F.expr(PLACE))).alias("at")
        every = settle(every.groupBy(*SEGMENT).agg(F.sum(F.when(F.col("own"), F.col("c")).otherwise(0)).alias("c"), F.count_if(~F.col("own")).alias("known"), first, at, F.first("n").alias("n")))

        # a segment's later occurrences go whole; its first one in the batch too, if history has it
        repeats = settle(every.where("c > 1").select(*SEGMENT, "c", F.when(F.col("known") == 0, F.col("at")).alias("stays")))
        whole = matched(anchors, repeats, SEGMENT).where(F.expr(f"NOT ({PLACE} <=> stays)")).select(*SPANS)
        whole = whole.unionByName(every.where("c = 1 AND known > 0").select("at.*", "n"))

        # windows one by one, for one copy of each segment of anchors that have several
        several = settle(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"))
        one = matched(every.select("anchor", "first.own", "first.k", "first.h", "first.lo", "n"), several, ["anchor"])
        windows = settle(documents.join(settle(per_document(one, "lo", "n", "own")), ["k", "h"]).mapInArrow(_windows, WINDOWS_SQL), **HASHES)
        earliest = windows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct("own", "k", "h", "lo")).alias("first")).where("c > 1")
        earliest = settle(earliest.select("w1", "w2", "c", F.struct("first.k", "first.h", "first.lo").alias("first")))
        later = matched(windows.where("own"), earliest, ["w1", "w2"]).where(f"{PLACE} != first").select("k", "h", "lo", F.lit(1).cast("long").alias("n"))

        spans = settle(per_document(whole.unionByName(later), "lo", "n"), keep=True)
    index.append(name)
    return spans


KEPT = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        starts, ends, first = words(data, offs)
        row, lo, n = span_lists(batch, "spans", "lo", "n")
        gone = covered(first[row] + lo, n + WINDOW - 1, len(starts))
        keep = np.flatnonzero(~gone)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
        joint = np.zeros(len(keep), np.int64)  # one space behind each kept word but a document's last
        joint[:-1] = doc[1:] == doc[:-1]
        raw = data.copy()
        raw[ends[keep[joint == 1]]] = 0x20
        length = ends[keep] - starts[keep] + joint
        rest = raw[ranges(starts[keep], length)].tobytes()
        total = np.append(0, np.cumsum(length))
        cut = total[np.searchsorted(doc, np.arange(len(first)))].tolist()
        kept = [rest[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        removed = np.append(0, np.cumsum(gone))[first]
        yield batch_of(KEPT, longs(batch, "k"), np.diff(first), np.diff(removed), kept)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """k, n_words, n_removed, kept (UTF-8): one row per document."""
    spark = docs.sparkSession
    conf_text_batches(spark)
    index, spans = FingerprintIndex(spark), None
    try:
        for batch, upto in batches_of(docs, doc_id, batches):
            got = repeats_in(keyed(docs.where(batch), doc_id, text), index, keyed(docs.where(upto), doc_id, text))
            spans = got if spans is None else spans.unionByName(got)
    finally:
        index.close()
    return without(keyed(docs, doc_id, text), spans)


def without(own: DataFrame, spans: DataFrame) -> DataFrame:
    """k, n_words, n_removed, kept: the documents (k, h, text) without the words of the windows (k, h, spans)."""
    lists = settle(spans.groupBy("k", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return own.join(lists, ["k", "h"], "left").mapInArrow(_kept, "k long, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
