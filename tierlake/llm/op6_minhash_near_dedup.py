"""MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding, verification, classes.

A document is the weighted set of its SHINGLE-word shingles (weight: times it
occurs). ProbMinHash: every shingle has a Poisson process of arrivals with its
weight as rate; each arrival falls on one of COMPONENTS components, and a
component takes the shingle that arrives first. Arrivals are drawn in increasing
order; once one comes later than every component's first, the shingle is done
(early termination). Two documents agree in a component with the probability
of their probability Jaccard similarity
    J_P = sum over common shingles i of 1 / sum over j of max(x_j / x_i, y_j / y_i).
BANDS bands of ROWS components give candidates: at J_P = 0.8 a pair shares a band
with a probability of 0.9999. Candidates are verified with their whole shingle
sets, J_P >= SIMILARITY, and the verified links' connected components are the
classes.

Groups: equal texts are one text first. Within a band's bucket no pairs are
emitted: every member is compared with the bucket's representative, its most
popular text. What verifies is one class; a bucket whose members are all in one
class needs nothing more. Members of the other buckets are compared across
classes, as far as they share one of their rarest shingles, which every similar
pair does (rare_shingles), and their sketches agree, which a pair at SIMILARITY
misses with a probability of 0.00016: copies cost one comparison each, and a passage
that many texts share makes no pairs.

Defined cases: null, empty and shorter texts than SHINGLE words have no shingles;
they are near none but rows with an equal text, if it has a word. Each row has
one result row: repeated doc_ids are rows of their own, with their text's class.
A class is named by its least doc_id (null: smallest). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, as_long, batch_of, cleanup, conf_text_batches, digests, grams, key_of, keyed, longs, mix, real_id, row_of, settle, slices, table, texts, unused, word_hashes, words
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Arrivals drawn in one step, at least.
DRAWS = 20_000


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of all rows, sorted by row and shingle, and the rows' numbers of words."""
    starts, ends, first = words(data, offs)
    n = np.diff(first)
    hashes = grams(word_hashes(data, starts, ends), SHINGLE, 21)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(row[: len(hashes)] == row[SHINGLE - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    row, hashes = row[inside], hashes[inside]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row))), n


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, size: int = COMPONENTS) -> np.ndarray:
    """(n_rows, size) signature; zero where a row has no shingles. All arrivals of a round are drawn at once."""
    first = np.full(n_rows * size, np.inf)
    owner = np.zeros(n_rows * size, U64)
    live = np.arange(len(row))
    time = np.zeros(len(row))
    drawn = 0
    while len(live):
        some = max(1, DRAWS // len(live))  # few live shingles: many arrivals of each at once
        number = np.arange(drawn + 1, drawn + some + 1, dtype=U64)[:, None]
        h = mix(shingle[live][None] + U64(0x9E3779B97F4A7C15) * (number << U64(1)))
        gap = -np.log(((h >> U64(11)).astype(float) + 0.5) * 2.0**-53) / weight[live]
        times = np.cumsum(np.concatenate([time[None], gap]), axis=0)[1:]
        part = (mix(h ^ U64(0xD6E8FEB86659FD93)) >> U64(32)) * U64(size) >> U64(32)
        cells = row[live][None] * size + part.astype(np.int64)
        early = np.flatnonzero((times < first[cells]).ravel())
        cell, when = cells.ravel()[early], times.ravel()[early]
        order = np.lexsort((when, cell))
        lead = np.ones(len(order), bool)
        lead[1:] = cell[order[1:]] != cell[order[:-1]]
        win = order[lead]
        first[cell[win]] = when[win]
        owner[cell[win]] = shingle[live[early[win] % len(live)]]
        limit = first.reshape(n_rows, size).max(1)
        going = np.flatnonzero(times[-1] < limit[row[live]])
        live, time, drawn = live[going], times[-1][going], drawn + some
    return owner.reshape(n_rows, size)


SIGNED = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SIGNED_SQL = "k long, h long, t1 long, t2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2: a digest of the text's bytes (0, 0: no words); bands: a hash per band, none without shingles."""
    for batch, data, offs in slices(batches, "text", 1 << 20):
        row, shingle, weight, n = shingles(data, offs)
        docs = len(n)
        signed = signatures(row, shingle, weight, docs).reshape(docs, BANDS, ROWS)
        band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (docs, BANDS)).copy()
        for k in range(ROWS):
            band = mix(band * U64(0x9E3779B97F4A7C15) + signed[:, :, k])
        some = np.bincount(row, minlength=docs) > 0
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * BANDS)), pa.int32()), pa.array(as_long(band[some].reshape(-1))))
        raw = data.tobytes()
        t1, t2 = (np.where(n > 0, t, 0) for t in digests(raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)))
        yield batch_of(SIGNED, longs(batch, "k"), longs(batch, "h"), t1, t2, lists)


SETS = pa.schema([("id", pa.int64()), ("shingles", pa.binary()), ("weights", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        row, shingle, weight, n = shingles(data, offs)
        cut = np.searchsorted(row, np.arange(len(n) + 1))
        light = weight.astype("<u4")
        pieces = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        yield batch_of(SETS, longs(batch, "id"), [shingle[a:b].tobytes() for a, b in pieces], [light[a:b].tobytes() for a, b in pieces])


def similarity(s1: np.ndarray, w1: np.ndarray, s2: np.ndarray, w2: np.ndarray) -> float:
    """Probability Jaccard similarity of two sets with sorted shingles."""
    both, i, j = np.intersect1d(s1, s2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = w1[i].astype(float), w2[j].astype(float)
    # with q = a / b: sum over k of max(x_k / a, y_k / b) = (x of those with x_k / y_k >= q) / a + (y of the others) / b
    ratio, wx, wy = a / b, a, b
    order = np.argsort(ratio, kind="stable")
    ratio, wx, wy = ratio[order], wx[order], wy[order]
    only_x, only_y = w1.sum() - wx.sum(), w2.sum() - wy.sum()
    at = np.searchsorted(ratio, ratio, "left")
    from_x = only_x + np.append(np.cumsum(wx[::-1])[::-1], 0.0)[at]
    from_y = only_y + np.append(0.0, np.cumsum(wy))[at]
    return float((1 / (from_x / wx + from_y / wy)).sum())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [
            similarity(np.frombuffer(s, "<u8"), np.frombuffer(w, "<u4"), np.frombuffer(s2, "<u8"), np.frombuffer(w2, "<u4")) >= SIMILARITY
            for s, w, s2, w2 in zip(b["shingles"], b["weights"], b["shingles2"], b["weights2"], strict=True)
        ]
        yield b.loc[np.array(got, bool), ["a", "b"]]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that are similar enough."""
    first = sets.select(F.col("id").alias("a"), "shingles", "weights")
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("shingles2"), F.col("weights").alias("weights2"))
    return pairs.join(second, "b").join(first, "a").mapInPandas(_verify, "a long, b long")


CELLS = 1 << 18
#: One bit of each of so many components: texts of similarity J have a bit in common with a probability of (1 + J) / 2.
SKETCH = 1024
#: A pair with J_P = 0.8 has 922 of them in common on average and fewer than this with a probability of 0.00016 (binomial).
AGREE = 886
#: A bit is hashed from shingle and component: the components that one shingle owns have bits independent of each other.
PLACES = mix(np.arange(1, SKETCH + 1, dtype=U64))


def sketches(sets: DataFrame) -> DataFrame:
    """id, sketch: SKETCH bits in longs."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offs in slices([whole], "shingles", 1 << 20):
                weight = texts(batch, "weights")[0].view("<u4").astype(float)
                signed = signatures(row_of(offs // 8), data.view("<u8"), weight, len(offs) - 1, SKETCH)
                packed = np.packbits((mix(signed ^ PLACES) >> U64(63)).astype(np.uint8), axis=1).view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1) * packed.shape[1], pa.int32()), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(longs(batch, "id")), lists], names=["id", "sketch"])

    return sets.select("id", "shingles", "weights").mapInArrow(bits, "id long, sketch array<long>")


def loss(before: str) -> str:
    """SQL of what a text adds to 2 / J_P at least, if so much of its weight is not common: J_P <= 2 / (loss of one + loss of the other)."""
    return f"(1 + {before}) / (1 - {before})"


MOST_LOSS = 2 / SIMILARITY + 1e-6
#: Rarest shared shingles of a text that its rows carry, to tell a pair's first common one.
HEAD = 16


def rare_shingles(sets: DataFrame) -> DataFrame:
    """id, shingle, before: each text's rarest shingles, as few as hold more than 1 - SIMILARITY of its weight; before: the share of its weight in rarer ones.

    J_P is at most the common part of the texts' weights, so at least SIMILARITY
    of either text's weight is common to a similar pair; with one order of rarity
    for all, the rarest common shingle is then among these of both. The order is
    by counts in CELLS cells (a table of fixed size, whatever the corpus), then by hash.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n += np.bincount((np.frombuffer(raw, "<u8") >> U64(46)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for cell, n in sets.select("shingles").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, rarer = [], [], []
            for key, raw, heavy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shingle, weight = np.frombuffer(raw, "<u8"), np.frombuffer(heavy, "<u4").astype(float)
                order = np.lexsort((shingle, counts[(shingle >> U64(46)).astype(np.int64)]))
                mass = np.cumsum(weight[order])
                few = order[: int(np.searchsorted(mass, (1 - SIMILARITY + 1e-9) * weight.sum(), "right")) + 1]
                ids.append(np.full(len(few), key))
                found.append(as_long(shingle[few].copy()))
                rarer.append((mass - weight[order])[: len(few)] / weight.sum())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, found, rarer)], names=["id", "shingle", "before"])

    return sets.select("id", "shingles", "weights").mapInArrow(rarest, "id long, shingle long, before double")


def across(rare: DataFrame, sketch: DataFrame) -> DataFrame:
    """a, b: texts of different classes that share a rare shingle (id, root, shingle, before) and agree in AGREE bits; members of a shingle's largest class aren't compared with each other.

    At a pair's first common shingle, what is rarer in either text is not common:
    shingles at which that alone makes the pair unlike (loss) are passed over. A pair
    whose first common shingle is in both heads is met there alone; other pairs may be met
    at several, and are made distinct.
    """
    rare = settle(rare)
    several = rare.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min("before").alias("soonest")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("classes"), F.min("soonest").alias("soonest")).where("classes > 1")
    kept = settle(rare.join(settle(several.select("shingle", "largest", "soonest")), "shingle").where(f"{loss('before')} + {loss('soonest')} <= {MOST_LOSS}").drop("soonest"))
    heads = kept.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("before", "shingle"))), 1, HEAD).getField("shingle").alias("head"))
    rare = settle(kept.join(settle(heads.join(sketch, "id")), "id"))
    other = rare.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "root", "before", "sketch", "head")])
    unlike = " + ".join(f"bit_count(sketch[{i}] ^ sketch2[{i}])" for i in range(SKETCH // 64))
    near = f"{loss('before')} + {loss('before2')} <= {MOST_LOSS} and {unlike} <= {SKETCH - AGREE} and coalesce(get(array_intersect(head, head2), 0), shingle) = shingle"
    both = rare.where("root != largest").join(other, "shingle").where("root != root2").where(near)
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def classes(own: DataFrame) -> DataFrame:
    """k, h, class_k, class_h: every document (as keyed() gives them) with the least one of its class."""
    with cleanup(own.sparkSession):
        signed = settle(own.mapInArrow(_sign, SIGNED_SQL), keep=True)
        # equal texts are one; its id is a hash of the text's hashes
        rep = signed.where("t1 != 0 or t2 != 0").groupBy("t1", "t2").agg(F.min(F.struct("k", "h")).alias("one"), F.first("bands").alias("bands"))
        rep = settle(rep.withColumn("id", F.xxhash64("t1", "t2")))
        buckets = rep.select("id", F.explode("bands").alias("band"))
        crowded = settle(buckets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
        members = settle(buckets.join(crowded, "band"))
        # a bucket's representative is its most popular member, the one that shares most bands with most texts: in a group of copies, mostly what they were copied from
        popular = settle(members.groupBy("id").agg(F.sum("c").alias("popular")))
        heads = settle(members.select("id", "band").join(popular, "id").groupBy("band").agg(F.max_by("id", F.struct("popular", "id")).alias("head")))
        tested = settle(members.join(heads, "band").where("id != head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())

        places = rep.join(members.select("id").distinct(), "id", "left_semi").select("id", "one.k", "one.h")
        sets = settle(own.join(places, ["k", "h"]).select("id", "text").mapInArrow(_sets, "id long, shingles binary, weights binary"))
        links = settle(verified(tested, sets))
        roots = components(links, "a", "b")
        # Buckets whose members are in several classes: across these classes, all pairs that could be similar enough
        placed = members.select("band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = settle(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band"))
        crossing = settle(placed.join(mixed, "band").select("id", "root").distinct())
        sketch = settle(sketches(sets.join(crossing, "id", "left_semi")))
        pairs = settle(across(rare_shingles(sets).join(crossing, "id"), sketch).join(tested, ["a", "b"], "left_anti"))
        more = settle(verified(pairs, sets))
        if not more.isEmpty():
            roots = components(links.unionByName(more), "a", "b")
        named = rep.join(roots.withColumnRenamed("node", "id"), "id", "left").select("t1", "t2", "one", F.coalesce("root", "id").alias("root"))
        texts = settle(named.join(named.groupBy("root").agg(F.min("one").alias("class")), "root").select("t1", "t2", "class"), keep=True)
    return signed.join(texts, ["t1", "t2"], "left").select("k", "h", F.coalesce("class.k", "k").alias("class_k"), F.coalesce("class.h", "h").alias("class_h"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id: one row per document."""
    conf_text_batches(docs.sparkSession)
    return classes(keyed(docs, doc_id, text)).select(real_id().alias("doc_id"), real_id("class_k").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id, and all its columns. Documents without words stay; rows with equal doc_id and text are one document."""
    conf_text_batches(docs.sparkSession)
    names, (k, h, c, near) = docs.columns, unused(docs, "k", "h", "c", "near")
    found = classes(keyed(docs)).groupBy("k", "h").agg(F.count("*").alias(c), F.first(F.expr("struct(k, h) != struct(class_k, class_h)")).alias(near)).where(F.col(near) | (F.col(c) > 1))
    found = settle(found.withColumnsRenamed({"k": k, "h": h}))
    marked = docs.withColumns(dict(zip((k, h), key_of(docs["doc_id"], docs["text"]), strict=True)))
    out = marked.join(found, [k, h], "left").where(~F.coalesce(F.col(near), F.lit(False)))
    if not found.where(~F.col(near)).isEmpty():
        again = out.where(F.col(c) > 1).dropDuplicates([k, h])
        out = out.where(F.col(c).isNull()).unionByName(again)
    return out.select(*names)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
