"""Best-fit packing: partitions best-fit locally, then underfull bins are merged in a tree of further best-fit rounds.

A document is its token ids and the end id; only longer ones than a sequence
are cut, into whole sequences and a shorter last piece. Each input partition
tokenises its pieces and packs them LOCAL_PIECES at a time (longest first, each
into the fullest bin with room), so a task's memory is bounded and only lengths
and places are ever shuffled, never ids. Bins that are nearly full are final. The
others go on as items: the first round deals them to groups of about GROUP_BINS,
which best-fit them; every next round merges FAN_IN groups to one, down to the
root. Two bins of more than half a sequence never share one, and best fit leaves
a group at most one that is not: so a group hands on that bin, and of the others,
which can only take in smaller ones, PASS of each fill. Thus no task ever
holds more than GROUP_BINS or FAN_IN x PASS x SEQUENCE / 2 bins, about.

Defined cases: null or empty text: the end id alone. Repeated rows are packed
each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from struct import pack as packed_longs

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf_text_batches, settle, table

SEQUENCE = 2048
END_ID = 0
#: A bin with less room than this is final.
NEARLY_FULL = 4
GROUP_BINS = 100_000
FAN_IN = 4
#: The rounds above a group take in fewer than FAN_IN bins each, so this many of a fill are enough for rounds / FAN_IN of them.
PASS = 24
LOCAL_PIECES = 50_000
#: Memory for the words that a worker remembers, twice, and what an entry takes besides its text and ids. When it is full, only words that come again stay.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 220
#: Longer words are not remembered.
CACHE_LETTERS = 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Words, as white space parts them, to their ids (little-endian unsigned 32-bit). The tokenizer drops white space, so words can be encoded one by one.

    Words of Latin letters go to the tokenizer's model directly, lower-cased and
    parted as its file says; all others go through the whole tokenizer.
    """

    #: The letters and digits among the first 256 code points, and the contractions that the tokenizer parts.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level: bytes that stand for themselves; the others follow from 256
        hidden = [b for b in range(256) if b not in set(shown)]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.room, self.old = CACHE_BYTES, {}

    def __missing__(self, word: str) -> bytes:
        if (got := self.old.get(word)) is not None:
            pass
        elif "<|" in word or not self.LATIN.fullmatch(word):
            got = self.encode_whole(word)
        elif (parts := self.PARTS.findall(word.lower())) == [word]:
            text = word if word.isascii() else "".join(map(self.char.__getitem__, word.encode()))
            got = packed_longs(f"<{len(ids := [t.id for t in self.model.tokenize(text)])}I", *ids)
        else:  # a part of a part is itself
            got = b"".join(map(self.__getitem__, parts))
        if len(word) <= CACHE_LETTERS:
            self.room -= len(word) + len(got) + ENTRY_BYTES
            if self.room < 0:
                self.old = self.copy()
                self.clear()
                self.room = CACHE_BYTES
            self[word] = got
        return got

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    ODD = re.compile("[\x1c-\x1f]")  # white space for str.split alone

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.encode_whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def best_fit(sizes: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the bin that it fills best. Bins are found by a bitmap of the rooms left."""
    bins, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    open_rooms, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = by_room[left].pop()
            if not by_room[left]:
                open_rooms ^= 1 << left
        else:
            left, k = room, made
            made += 1
        bins[i], at[i] = k, room - left
        if left > size:
            if not by_room[left - size]:
                open_rooms |= 1 << (left - size)
            by_room[left - size].append(k)
    return bins, at


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64())])
_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, local_pieces: int) -> Iterator[pa.RecordBatch]:
    ids, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
    rows: list[tuple] = []
    used = TaskContext.get().partitionId() << 36

    def packed() -> pa.RecordBatch:
        nonlocal used
        bins, at = best_fit(np.array([r[3] for r in rows], np.int64))
        cols = [*zip(*rows, strict=True), bins + used, at]
        used += len(rows)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, PIECES, strict=True)], schema=PIECES)

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            got, doc = ids.encode(text.as_py() or "") + end, doc.as_py()
            for k, a in enumerate(range(0, len(got), 4 * SEQUENCE)):
                part = got[a : a + 4 * SEQUENCE]
                rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= local_pieces:
                yield packed()
    if rows:
        yield packed()


MOVES = "g long, bin long, target long, shift long, total long, up boolean"


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Where each bin goes (target, shift), the new bin's fill, and whether the next round sees it (up; in the row of its first one)."""
    group = group.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
    k, shift = best_fit(group["fill"].to_numpy(np.int64))
    first = np.full(k.max() + 1, -1, np.int64)
    first[k[shift == 0]] = group["bin"].to_numpy()[shift == 0]  # the new bin has its first one's number
    total = np.bincount(k, group["fill"]).astype(np.int64)
    out = pd.DataFrame({"g": group["g"], "bin": group["bin"], "target": first[k], "shift": shift, "total": total[k]})
    heads = out[(out["shift"] == 0) & (out["total"] <= SEQUENCE - NEARLY_FULL)]
    out["up"] = False
    out.loc[heads.index[heads.groupby("total").cumcount() < PASS], "up"] = True
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    conf_text_batches(docs.sparkSession)
    path = path or tokenizer_path()
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    local_pieces = LOCAL_PIECES
    pieces = settle(own.mapInArrow(lambda it: _pieces(it, path, local_pieces), _SQL))
    underfull = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") <= SEQUENCE - NEARLY_FULL)
    underfull = settle(underfull)
    moves, groups = None, -(-underfull.count() // GROUP_BINS)
    dealt = underfull.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(max(groups, 1))))
    while groups:
        merged = settle(dealt.groupBy("g").applyInPandas(_merge, MOVES))
        step = merged.select("bin", "target", "shift")
        if moves is None:
            moves = step
        else:  # what has moved to a bin moves on with it
            on = step.select(F.col("bin").alias("target"), F.col("target").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(on, "target", "left").select("bin", F.coalesce("next", "target").alias("target"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        up = merged.where("up")
        if groups == 1 or up.where(2 * F.col("total") <= SEQUENCE).isEmpty():  # two larger ones never share
            break
        dealt = up.select(F.floor(F.col("g") / FAN_IN).alias("g"), F.col("target").alias("bin"), F.col("total").alias("fill"))
        groups = -(-groups // FAN_IN)
    if moves is None:
        moves = underfull.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"))
    out = pieces.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("target", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
