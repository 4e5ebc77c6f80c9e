"""Folding an operation log (seq, k, v, op) into keyed state, and reading along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import numbered


def writes(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op").isin("put", "delete"))


def last_wins(ops: DataFrame) -> DataFrame:
    """k, seq, v: each key's last write; keys whose last write is a delete are gone. Partial maxima before the shuffle."""
    last = writes(ops).groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("w"))
    return last.where("w.op != 'delete'").select("k", "w.seq", "w.v")


def first_wins(ops: DataFrame) -> DataFrame:
    """k, seq, v: each key's first put; later ones leave it untouched."""
    return ops.where("op = 'put'").groupBy("k").agg(F.min("seq").alias("seq"), F.min_by("v", "seq").alias("v"))


def reads_along(ops: DataFrame) -> DataFrame:
    """seq, k, found, v of every get: what the last write before it left."""
    before = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("op").isin("put", "delete"), F.struct("op", "v"))
    seen = ops.withColumn("w", F.last(write, ignorenulls=True).over(before)).where("op = 'get'")
    found = F.coalesce(F.col("w.op") == "put", F.lit(False))
    return seen.select("seq", "k", found.alias("found"), F.when(found, F.col("w.v")).alias("v"))


def present_before(ops: DataFrame, write: Column | None = None) -> DataFrame:
    """ops with `present`: the key's last write (put or delete, else null) before the row is a put."""
    before = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("op").isin("put", "delete"), F.col("op")) if write is None else write
    return ops.withColumn("present", F.coalesce(F.last(write, ignorenulls=True).over(before) == "put", F.lit(False)))


def replay(ops: DataFrame) -> DataFrame:
    """op, n, effective: puts of absent keys, deletes and gets of present ones take effect."""
    took = F.when(F.col("op") == "put", ~F.col("present")).otherwise(F.col("present"))
    return present_before(ops.where(F.col("op") != "range")).groupBy("op").agg(F.count("*").alias("n"), F.count_if(took).alias("effective"))


def merge_levels(*levels: DataFrame) -> DataFrame:
    """k, v, level: the newest level's row of each key; levels from old to new, each with k and v."""
    every = None
    for i, level in enumerate(levels):
        own = level.select("k", "v", F.lit(i).alias("level"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("k").agg(F.max_by("v", "level").alias("v"), F.max("level").alias("level"))


def landing_epochs(ops: DataFrame, shards: int, slots: int) -> DataFrame:
    """shard, epoch, absorbed, compacted: a shard's writes fill a landing buffer of `slots`; when full, the last write of each key is compacted."""
    own = writes(ops).select("seq", "k", F.pmod("k", F.lit(shards)).alias("shard"))
    parted = numbered(own, "seq", "number", ["shard"]).withColumn("epoch", F.floor(F.col("number") / slots))
    kept = parted.groupBy("shard", "epoch", "k").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    return kept.groupBy("shard", "epoch").agg(F.sum("n").alias("absorbed"), F.count("*").alias("compacted"), F.max("seq").alias("last_seq"))


def dirty_keys(ops: DataFrame, slots: int) -> DataFrame:
    """k, first_seq: the first `slots` different keys written."""
    return writes(ops).groupBy("k").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(slots)
