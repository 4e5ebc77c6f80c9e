"""What the operators share: scratch tables, Arrow text access and vectorised hashing.

All hashing works on whole texts as UTF-8 bytes, in slices of a few MB that
never cut a document, so that a task's memory follows the slice (or its longest
document) and not the partition. Hashes of bytes are worked out in blocks, so a
very long document costs what is kept of it, and not what leads there.

No hash here is a polynomial: every step mixes, so texts that cancel out in a
ring (Thue-Morse words modulo 2^64) have different hashes as any others have.
What removes text without a further look is a digest (blake2b, 128 bits) of
the bytes or words themselves.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, which is set here only where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tierlake-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that the steps now running have written, the innermost step's last.
_STEPS: list[list[str]] = []


def settle(df: DataFrame, keep: bool = False, **options: str) -> DataFrame:
    """Write df to a shared table and read it back: later steps and lost executors start from the files. Within cleanup() it goes with its step; keep: with the step around that."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    if len(_STEPS) > keep:
        _STEPS[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(settled: DataFrame) -> None:
    """Drops a table that settle() has written."""
    for path in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        delete(settled.sparkSession, path)


@contextlib.contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what was settled within and not kept: disk follows a step, not the whole job."""
    _STEPS.append([])
    try:
        yield
    finally:
        for path in _STEPS.pop():
            delete(spark, path)


#: Keys from here up to NULL_ID + 2^32 - 1 stand for null doc_ids; they count as the smallest.
NULL_ID = -(2**63)


def key_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """k and h of a row: k is the doc_id, and for null NULL_ID and 32 bits of a hash of the text; h is another hash of the text (64 bits)."""
    null = F.lit(NULL_ID) + F.xxhash64(F.lit("null"), text).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.coalesce(doc_id.cast("long"), null), F.xxhash64(text)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h (key_of) and text: rows with equal k and h count as one document. Ids below NULL_ID + 2^32 count as null."""
    k, h = key_of(docs[doc_id], docs[text])
    return docs.select(k.alias("k"), h.alias("h"), docs[text].alias("text"))


def real_id(k: str = "k"):
    """doc_id again."""
    return F.when(F.col(k) >= F.lit(NULL_ID + 2**32), F.col(k))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def once(column):
    """The column as it is, worked out once a row: filters and lambdas above can't take its expression in and repeat it."""
    return F.explode(F.array(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------
# Arrow text


def texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after another, and each row's first byte (with the end last); null: empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most `size` bytes, or of one longer document."""
    for batch in batches:
        data, offs = texts(batch, column)
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).to_numpy(zero_copy_only=False)


# --------------------------------------------------------------------------
# Words and hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each document's first word (with the end last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = solid[inner]  # a document's first byte starts a word, whatever stands before it
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _odd(seed: int) -> int:
    return (int(mix(np.array([seed], U64))[0]) | 1) & ((1 << 64) - 1)


#: Bytes that one step of hashing handles at once, and places of a span whose values come from a table.
BLOCK = 1 << 18
TABLE = 64
_STEP = U64(0x9FB21C651E98DF25)


@functools.lru_cache(16)
def _values(seed: int) -> np.ndarray:
    return mix(np.arange(TABLE * 256, dtype=U64) * U64(_odd(seed)) + U64(seed + 1))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each span of bytes: the sum of a random value for every byte at its place in the span, mixed. Memory is a block's, however long a span."""
    lengths = ends - starts
    out = np.zeros(len(starts), U64)
    table, factor, last = _values(seed), U64(_odd(seed)), U64(seed + 1)
    upto = np.append(0, np.cumsum(lengths))
    at = 0
    while at < len(starts):
        if lengths[at] > BLOCK:
            for a in range(0, int(lengths[at]), BLOCK):
                part = data[starts[at] + a : min(starts[at] + a + BLOCK, ends[at])]
                code = (np.arange(a, a + len(part), dtype=U64) << U64(8)) + part
                out[at : at + 1] += mix(code * factor + last).sum(dtype=U64)
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        n = lengths[at:to]
        some = np.flatnonzero(n)
        n = n[some]
        if len(n):
            before = np.cumsum(n) - n
            place = np.arange(int(before[-1] + n[-1])) - np.repeat(before, n)
            code = (place << 8) + data[place + np.repeat(starts[at:to][some], n)]
            if n.max() <= TABLE:
                value = table[code]
            else:
                value = table[np.minimum(code, len(table) - 1)]
                far = np.flatnonzero(place >= TABLE)
                value[far] = mix(code[far].astype(U64) * factor + last)
            out[at + some] = np.add.reduceat(value, before)
        at = to
    return mix(out + lengths.astype(U64) * _STEP)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return span_hashes(data, starts, ends, seed)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each starts there (with the end last)."""
    at = np.append(0, np.cumsum(ends - starts + 1))
    out = np.append(data, np.uint8(0x20))[ranges(starts, ends - starts + 1)]
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def grams_at(symbols: np.ndarray, places: Sequence[int], seed: int = 0) -> np.ndarray:
    """Hashes of the symbols (64-bit, as word_hashes gives them) at these places, from every start on."""
    n = len(symbols) - places[-1]
    if n <= 0:
        return np.zeros(0, U64)
    h = symbols[:n] ^ U64(_odd(seed))
    for j in places[1:]:
        h ^= h >> U64(32)
        h = h * _STEP + symbols[j : j + n]
    return mix(h)


def grams(symbols: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k symbols."""
    return grams_at(symbols, range(k), seed)


def byte_grams(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k bytes, 8 or more: they are read as eights, the last of them ending the run."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    raw, out, first = np.ascontiguousarray(data), np.empty(n, U64), U64(_odd(seed))
    for a in range(0, n, BLOCK >> 2):
        m = min(n - a, BLOCK >> 2)
        eights = mix(np.ndarray((m + k - 8,), "<u8", raw.data, a, strides=(1,)) ^ first)
        h = eights[:m]
        for j in [*range(8, k - 7, 8), k - 8] if k % 8 else range(8, k - 7, 8):
            h = h * _STEP
            h ^= h >> U64(32)
            h += eights[j : j + m]
        out[a : a + m] = mix(h * _STEP)
    return out


def digests(bodies: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """blake2b of each text, 128 bits as two longs: what tells texts apart for good."""
    raw = b"".join([hashlib.blake2b(b, digest_size=16).digest() for b in bodies])
    both = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1]) if width > span else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def row_of(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def conf_text_batches(spark: SparkSession) -> None:
    """Arrow batches of few long texts, for small memory in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


__all__ = [n for n in dir() if not n.startswith("_")] + ["F"]
