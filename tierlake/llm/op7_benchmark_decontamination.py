"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits, A-Z lower-cased. Three words of a test item
within four in a row (SHAPES) are a seed, however frequent they are: a passage that
holds one, with at most one word in between, is found in a corpus of any size.
Documents are joined to the seeds by hash; near the hits, the passage is aligned with the whole item,
word by word, and the best local score, as a share of the score of a perfect copy,
is the result. At SCORE or more it is a leak. What chance joins is mostly not aligned: a
passage that holds too few of the item's words can't reach SCORE (an exact bound).

Why these seeds: a copy at SCORE 0.5 with replaced words has two thirds of the
item's words in place, so some four words in a row hold three of them, wherever
the others are. Only passages shorter than that, or cut up by insertions, can be missed.

Test items are a query set against all documents: they are taken in blocks of at
most BLOCK_WORDS words, and only a block is sent to the tasks. Documents are never
shuffled; a very frequent passage costs each document that holds it one alignment.

Defined cases: null or empty texts have no words and no hits. An item of fewer
than SEED words is found only as a whole: its whole word sequence is the seed.
Repeated documents give repeated rows; items with equal item_id and text count once.
Null ids are ids like any other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import conf_text_batches, slices, span_hashes, table
from .op9_quality_classifier import _KIND, tokens

SEED = 3
#: Places of a seed's words.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (no runs of punctuation), and the index of each document's first one."""
    starts, ends, _, low = tokens(data, offs)
    word = _KIND[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    return span_hashes(low, starts, ends, 7), np.searchsorted(starts, offs)


def grams(words: np.ndarray, first: np.ndarray, n: int, shape: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (or of the words at the places of shape) within documents, and where each starts."""
    if shape is None or shape[-1] == n - 1:
        got = common.grams(words, n, 8)
    else:  # the same hash as that of these words next to each other
        got = common.grams_at(words, shape, 8)
        n = shape[-1] + 1
    ok = np.ones(len(got), bool)
    for k in range(1, n):  # no n-gram runs over a border
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    where = np.flatnonzero(ok)
    return got[where], where


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """The best local alignment's score: one row of cells at a time; gaps along the row by a running maximum."""
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    slope = -GAP * np.arange(len(passage) + 1)
    for w in item:
        cells = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP, out=cells[1:])
        np.maximum(cells, 0, out=cells)
        row = np.maximum.accumulate(cells + slope) - slope
        best = max(best, int(row.max()))
    return best


class Block:
    """Test items, the hashes of their words, and their seeds (sorted by hash)."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [t.encode() for _, t in items]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        words, first = hashed_words(data, offs)
        keep = np.flatnonzero(np.diff(first))
        self.ids = np.array([items[k][0] for k in keep], np.int64)
        self.words = [words[first[k] : first[k + 1]] for k in keep]
        hashes, short = [], []
        for k, w in enumerate(self.words):
            if len(w) < SEED:
                short.append((int(common.grams(w, len(w), 8)[0]), k))
            else:
                hashes.extend((int(h), k) for h in np.unique(np.concatenate([common.grams_at(w, shape, 8) for shape in SHAPES])))
        self.hashes, self.items = self._sorted(hashes)
        self.short = {n: self._sorted([(h, k) for h, k in short if len(self.words[k]) == n]) for n in range(1, SEED)}

    @staticmethod
    def _sorted(pairs: list) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted(pairs)
        return np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)


def _hits(hashes: np.ndarray, items: np.ndarray, got: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) for every n-gram that is a seed; a seed of several items hits each."""
    if not len(hashes) or not len(got):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.searchsorted(hashes, got, "left")
    maybe = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == got)
    low, high = low[maybe], np.searchsorted(hashes, got[maybe], "right")
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(where[maybe], n), items[at]


LEAKS = "doc_id long, item_id long, score double, first_word long, n_words long"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def leaks_of(block: Block, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(row, item_id, score, first word and number of words of the passage): the best passage of each row and item."""
    words, first = hashed_words(data, offs)
    found = [_hits(block.hashes, block.items, *grams(words, first, SEED, shape)) for shape in SHAPES]
    found += [_hits(*block.short[n], *grams(words, first, n)) for n in range(1, SEED) if len(block.short[n][0])]
    place, item = np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])
    if not len(place):
        return []
    doc = np.searchsorted(first, place, "right") - 1
    order = np.lexsort((place, item, doc))
    place, item, doc = place[order], item[order], doc[order]
    size = np.array([len(w) for w in block.words])[item]
    new = np.ones(len(place), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > size[1:])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(place)) - 1
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    memo: dict[tuple[int, bytes], int] = {}
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        d, k, n = int(doc[a]), int(item[a]), int(size[a])
        low, high = max(int(first[d]), int(place[a]) - n), min(int(first[d + 1]), int(place[b]) + 2 * n)
        passage = words[low:high]
        if (key := (k, passage.tobytes())) not in memo:
            most = MATCH * np.count_nonzero(np.isin(block.words[k], passage))
            memo[key] = align(block.words[k], passage) if most >= SCORE * MATCH * n else 0
        score = memo[key] / (MATCH * n)
        if score >= SCORE and score > best.get((d, k), (0.0,))[0]:
            best[d, k] = (score, low - int(first[d]), high - low)
    return [(d, int(block.ids[k]), *v) for (d, k), v in best.items()]


def _leaks(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        if got := leaks_of(block, data, offs):
            ids = batch.column(0).to_pylist()
            cols = [*zip(*[(ids[d], *rest) for d, *rest in got], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _LEAKS, strict=True)], schema=_LEAKS)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items, BLOCK_WORDS at a time."""
    out, n = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null").distinct()
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        size = len(text) // 2 + 1
        if out and n + size > BLOCK_WORDS:
            yield out
            out, n = [], 0
        out.append((item, text))
        n += size
    if out:
        yield out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words: every document with a passage that aligns with a test item."""
    conf_text_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for block in map(Block, blocks(benchmark)):
        out = out.unionByName(own.mapInArrow(lambda it, block=block: _leaks(it, block), LEAKS))
    return out


def _clean(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        keep = np.ones(batch.num_rows, bool)
        keep[[d for d, *_ in leaks_of(block, data, offs)]] = False
        yield batch.filter(pa.array(keep))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no passage of a test item."""
    conf_text_batches(docs.sparkSession)
    out = docs
    for block in map(Block, blocks(benchmark)):
        out = out.mapInArrow(lambda it, block=block: _clean(it, block), docs.schema)
    return out


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
