"""Second-chance eviction and its triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import running


def second_chance(pages: DataFrame, target: int, page_bytes: int = 4096) -> DataFrame:
    """shard, page, turn: the pages that go until `target` bytes of a shard are free, in two rounds at most.

    pages: shard, page, accessed. The first round takes those not accessed since the last one, in the order of pages,
    and clears the others' bits, so the second round takes these. That is a rank; only the first ones of a shard are
    kept, and Spark keeps no more of any partition.
    """
    turn = F.row_number().over(Window.partitionBy("shard").orderBy("accessed", "page"))
    return pages.withColumn("turn", turn).where(F.col("turn") <= -(-target // page_bytes)).select("shard", "page", (F.col("turn") - 1).cast("long").alias("turn"))


def pressure(puts: DataFrame, capacity: int, evict_at: float) -> DataFrame:
    """puts (seq, size) with used (bytes with this one) and whether that calls for eviction."""
    used = running(puts, "seq", F.col("size"), "before")
    return used.withColumn("used", F.col("before") + F.col("size")).drop("before").withColumn("evict", F.col("used") >= F.lit(capacity * evict_at))
