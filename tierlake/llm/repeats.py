"""Repeated windows across documents: the Spark part that suffix-array dedup and substring dedup share.

An occurrence (k, h, lo, n) is a document and n neighbouring windows of it that
one anchor stands for (see anchors.py). Most anchors occur once in the corpus;
their windows are unique and leave at once. Everything here is grouping and
joins on hashes, never a group's rows in one task: a passage that a third of
all documents share costs a partial count per task, and its rows are joined
where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, unused

ANCHORS = pa.schema([("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("shift", pa.int64())])
ANCHORS_SQL = "anchor long, s1 long, s2 long, k long, h long, lo long, n long, shift long"

#: A group with more than this part of all rows is hot; there can't be more than HOT of them, so they are broadcast.
HOT = 10_000


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], counts: str = "c") -> DataFrame:
    """The rows whose keys (longs) are in groups (a settled table, one row per key; counts: how many rows the key has), with the groups' other columns.

    Rows of hot groups are joined by broadcast, and spread by a hash of the whole row on their way.
    """
    extra = [c for c in groups.columns if c not in keys and c != counts]
    total, most = groups.agg(F.sum(counts), F.max(counts)).head()
    limit = (total or 0) // HOT + 1
    if (most or 0) <= limit:
        return rows.join(groups.drop(counts), keys)
    hot = groups.where(F.col(counts) > limit)
    own, (is_hot, spread, found) = rows.columns, unused(rows, "hot", "spread", "found")
    hot = hot.select(*keys, *[F.col(c).alias(f"{c}_hot") for c in extra], F.lit(True).alias(is_hot))
    flagged = rows.join(F.broadcast(hot), keys, "left")
    flagged = flagged.withColumn(spread, F.when(F.col(is_hot), F.xxhash64(*own)).otherwise(F.col(keys[0])))
    cold = groups.where(F.col(counts) <= limit).select(F.col(keys[0]).alias(spread), *keys[1:], *[F.col(c).alias(f"{c}_cold") for c in extra], F.lit(True).alias(found))
    out = flagged.join(cold, [spread, *keys[1:]], "left").where(F.col(is_hot) | F.col(found))
    return out.select(*own, *[F.when(F.col(is_hot), F.col(f"{c}_hot")).otherwise(F.col(f"{c}_cold")).alias(c) for c in extra])


def repeated(anchors: DataFrame) -> DataFrame:
    """The occurrences of anchors that occur more than once, with `several`: the anchor has more than one segment."""
    differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    found = settle(anchors.groupBy("anchor").agg(F.count("*").alias("c"), differ.alias("several")).where("c > 1"))
    return matched(anchors, found, ["anchor"])


def per_document(spans: DataFrame, *fields: str) -> DataFrame:
    """One row per document with the list of its spans: no longer than the document itself."""
    return spans.groupBy("k", "h").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def span_lists(batch: pa.RecordBatch, column: str, *fields: str) -> tuple[np.ndarray, ...]:
    """(row, field, field, ...) of all spans of a batch; null lists are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    row = pa.compute.list_parent_indices(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    return (row, *[flat.field(f).to_numpy(zero_copy_only=False) if not flat.offset and len(flat.field(f)) == len(flat) else pa.compute.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in fields])
