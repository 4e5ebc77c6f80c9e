"""Large objects: append-only places, descriptors, checked reads, pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.prefix import numbered, running


def appended(objects: DataFrame, alignment: int) -> DataFrame:
    """objects (seq, size) with aligned size and lba: each starts where the one before ends."""
    aligned = objects.withColumn("aligned", F.ceil(F.col("size") / alignment) * alignment)
    return running(aligned, "seq", F.col("aligned"), "lba")


def counted(objects: DataFrame) -> DataFrame:
    """objects with lba 1, 2, 3 ... by seq, whatever their size."""
    return numbered(objects, "seq", "at").withColumn("lba", F.col("at") + 1).drop("at")


def read_checked(descriptors: DataFrame, storage: DataFrame, checksum) -> DataFrame:
    """descriptors (seq, lba, size, checksum) with status: OK, or IO_ERROR if storage (lba, body) has nothing there, too little or something else."""
    body = storage.select("lba", "body", checksum(F.col("body")).alias("found"))
    met = descriptors.join(body, "lba", "left")
    good = (F.octet_length("body") == F.col("size")) & (F.col("found") == F.col("checksum"))
    return met.select(*descriptors.columns, F.when(F.coalesce(good, F.lit(False)), "OK").otherwise("IO_ERROR").alias("status"))


def pointer(lba: Column, size: Column, checksum: Column) -> Column:
    return F.struct(lba.cast("long").alias("lba"), size.cast("long").alias("size"), checksum.cast("long").alias("checksum"))


def pointers(probes: DataFrame, state: DataFrame) -> DataFrame:
    """probes (k) with lba, size and checksum of their pointer (state: k, p); zeros if there is none."""
    met = probes.join(state.select("k", "p"), "k", "left")
    return met.select(*probes.columns, *[F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("long")).alias(c) for c in ("lba", "size", "checksum")])


def pointer_status(ops: DataFrame) -> DataFrame:
    """seq, k, op, status of puts and deletes (seq, k, op, p): 0, or -1 for a put of no valid pointer and a delete of an absent key."""
    from .oplog import present_before

    valid = F.coalesce(S.pointer_is_valid(F.col("p.lba"), F.col("p.size")), F.lit(False))
    took = ops.where((F.col("op") == "delete") | (F.col("op") == "put")).withColumn("took", (F.col("op") == "delete") | valid)
    there = present_before(took, F.when(F.col("took"), F.col("op")))
    good = F.when(F.col("op") == "put", F.col("took")).otherwise(F.col("present"))
    return there.select("seq", "k", "op", F.when(good, 0).otherwise(-1).alias("status"))
