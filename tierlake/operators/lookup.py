"""Point, range and tier lookups, batched: a set of probes against a table of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import nearest_below, numbered


def points(probes: DataFrame, state: DataFrame, missing: float = -1.0) -> DataFrame:
    """probes with v: the key's value, or `missing`. The probes are the streamed side; Spark broadcasts the state only if it is small."""
    return probes.join(state.select("k", "v"), "k", "left").withColumn("v", F.coalesce("v", F.lit(missing)))


def normalised(ranges: DataFrame) -> DataFrame:
    """Ranges (id, lo, hi) with swapped bounds put right."""
    return ranges.select("id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))


def last_in(ranges: DataFrame, state: DataFrame) -> DataFrame:
    """id, v: the value of the greatest key of each range (bounds in any order); null if there is none. It is the nearest key below the upper bound, so no range is listed."""
    found = nearest_below(normalised(ranges), "hi", state, "k", ["v"])
    return found.select("id", F.when(F.col("k") >= F.col("lo"), F.col("v")).alias("v"))


def ranges_with(ranges: DataFrame, state: DataFrame) -> DataFrame:
    """The ranges (bounds as they are) that hold a key at all."""
    return nearest_below(ranges.where("lo <= hi"), "hi", state.select("k"), "k", []).where("k >= lo").select(*ranges.columns)


def counts_in(ranges: DataFrame, state: DataFrame, name: str) -> DataFrame:
    """id and how many keys each range has (bounds as they are; swapped: none): the difference of two keys' numbers."""
    keys = numbered(state.select("k"), "k", "at")
    ends = ranges.select("id", F.explode(F.array(F.struct(F.col("hi").alias("x"), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("x"), F.lit(-1).alias("sign")))).alias("e")).select("id", "e.*")
    upto = nearest_below(ends, "x", keys, "k", ["at"])
    return upto.groupBy("id").agg(F.greatest(F.sum(F.col("sign") * (F.coalesce("at", F.lit(-1)) + 1)), F.lit(0)).alias(name))


def routed(probes: DataFrame, separators: DataFrame) -> DataFrame:
    """probes (k) with leaf: that of the greatest separator (least, leaf) at most k; smaller keys go to the first leaf."""
    found = nearest_below(probes, "k", separators, "least", ["leaf"])
    return found.select(*probes.columns, F.coalesce("leaf", F.lit(0)).alias("leaf"))


def newest_tier(*tiers: DataFrame) -> DataFrame:
    """k, tier, v: from the first tier in order that has the key; tiers have k, v and tier."""
    every = None
    for prio, tier in enumerate(tiers):
        own = tier.select("k", "v", "tier", F.lit(prio).alias("prio"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("k").agg(F.min_by(F.struct("tier", "v"), "prio").alias("x")).select("k", "x.tier", "x.v")


def bucket_meets(lo: Column, hi: Column, bucket: Column, n: int) -> Column:
    """Has a key of the bucket (key modulo n) a place between lo and hi, whichever is less?"""
    low, high = F.least(lo, hi), F.greatest(lo, hi)
    return low + F.pmod(bucket - F.pmod(low, F.lit(n)), F.lit(n)) <= high
