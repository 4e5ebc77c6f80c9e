"""Pages of keys: packing in order, splitting, separators, page space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import numbered


def packed(keys: DataFrame, slots: int) -> DataFrame:
    """k, leaf: `slots` keys after each other to a leaf, over the whole table."""
    return numbered(keys.select("k"), "k", "at").select("k", F.floor(F.col("at") / slots).alias("leaf"))


def separators(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("leaf").agg(F.min("k").alias("least"), F.max("k").alias("greatest"), F.count("*").alias("n"))


def ranked(keys: DataFrame, group: str) -> DataFrame:
    """k, group, r (its place in the group from 0), n (the group's keys). group is a page, so it holds a page's keys at most."""
    own = Window.partitionBy(group)
    return keys.select(group, "k").withColumns({"r": F.row_number().over(own.orderBy("k")) - 1, "n": F.count("*").over(own)})


def median_split(keys: DataFrame, group: str) -> DataFrame:
    """group, separator, n_left, n_right: the lower half of each group's keys goes left, the first of the upper half is the separator."""
    left = F.col("r") < F.floor(F.col("n") / 2)
    return ranked(keys, group).groupBy(group).agg(F.min(F.when(~left, F.col("k"))).alias("separator"), F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))


def space(counts: DataFrame, entries: int, page_bytes: int = 4096, header: int = 16, entry_bytes: int = 12) -> DataFrame:
    """Used and unused bytes of pages with n entries."""
    used = F.lit(header) + F.least(F.col("n"), F.lit(entries)) * entry_bytes
    return counts.withColumns({"used": used, "unused": F.lit(page_bytes) - used, "unused_percent": F.round((F.lit(page_bytes) - used) * 100.0 / page_bytes, 6)})
