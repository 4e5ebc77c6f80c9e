"""Streams over the operation log: folds, windows and bounded queues that go on after a restart.

Every micro-batch is folded by aggregates to what it says per key or window and written under its number, so a batch that
is run again overwrites itself. What a reader sees is the fold of these parts. With a path (base) a job's parts and its
checkpoint stay there: the next start reads only what is new. Nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.oplog import present_before, writes
from ..sources.tables import operations, scratch


def event_stream(spark: SparkSession, sf_dir: str, pattern: str = "events.parquet") -> DataFrame:
    """The events files as a stream; ts as a timestamp, so that it can carry a watermark."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(f"{sf_dir}/events.parquet" if pattern == "events.parquet" else sf_dir).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def operation_stream(spark: SparkSession, sf_dir: str, pattern: str = "events.parquet") -> DataFrame:
    return operations(event_stream(spark, sf_dir, pattern))


def folded(stream: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], schema: str, base: str | None = None, mode: str = "append") -> DataFrame:
    """The parts of all batches so far with their `batch`: drains what the stream has now, and stops. fold takes a batch's rows and the parts of the batches before it."""
    spark, base = stream.sparkSession, base or scratch(stream.sparkSession)
    fields = f"{schema}, batch long"

    def parts(session: SparkSession) -> DataFrame:
        return session.read.schema(fields).parquet(f"{base}/parts") if _has(session, f"{base}/parts") else session.createDataFrame([], fields)

    def put(rows: DataFrame, number: int) -> None:
        fold(rows, parts(rows.sparkSession).where(F.col("batch") < number)).write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return parts(spark)


def _has(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def compacted_state(ops: DataFrame, base: str | None = None) -> DataFrame:
    """k, seq, v: live keys. A batch leaves the last write of each of its keys."""
    last = lambda rows: rows.groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("w")).select("k", "w.*")
    parts = folded(ops, lambda rows, _: last(writes(rows)), "k long, seq long, op string, v double", base)
    return last(parts).where("op != 'delete'").select("k", "seq", "v")


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days", base: str | None = None) -> DataFrame:
    """start, event_type, n: tumbling (or sliding) windows by event time behind a watermark; later events are left out. The counts are keyed state of the stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"))
    parts = folded(counts, lambda rows, _: rows.select(F.col("window.start").alias("start"), "event_type", "n"), "start timestamp, event_type string, n long", base, "update")
    return parts.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def hits_by_key(ops: DataFrame, base: str | None = None) -> DataFrame:
    """k, gets, hits: gets of keys that are present. A batch leaves, per key, its gets before its first write, those after, which of these hit, and its last write."""

    def fold(rows: DataFrame, _: DataFrame) -> DataFrame:
        wrote = F.count(F.when(F.col("op").isin("put", "delete"), True)).over(Window.partitionBy("k").orderBy("seq")) > 0
        own, get = present_before(rows).withColumn("wrote", wrote), F.col("op") == "get"
        write = F.when(F.col("op").isin("put", "delete"), F.col("op"))
        return own.groupBy("k").agg(F.count_if(get).alias("gets"), F.count_if(get & ~F.col("wrote")).alias("open"), F.count_if(get & F.col("present")).alias("hits"), F.max_by("op", F.when(write.isNotNull(), F.col("seq"))).alias("last"))

    parts = folded(ops, fold, "k long, gets long, open long, hits long, last string", base)
    before = Window.partitionBy("k").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a key's batches, not its rows
    known = parts.withColumn("present", F.coalesce(F.last("last", ignorenulls=True).over(before) == "put", F.lit(False)))
    return known.groupBy("k").agg(F.sum("gets").alias("gets"), F.sum(F.col("hits") + F.when(F.col("present"), F.col("open")).otherwise(0)).alias("hits"))


def _first(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps no more of any partition."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("turn") <= n).drop("turn")


def dirty_queues(ops: DataFrame, shards: int, slots: int, base: str | None = None) -> DataFrame:
    """shard, queued, merged, dropped: a shard's queue takes its first `slots` different keys written; writes of keys in the queue merge, all others are dropped and counted.

    A batch leaves the writes of the keys that are in the queue or could get there, and the number of all writes: no more rows than the queues have slots, twice.
    """

    def queue_of(keys: DataFrame) -> DataFrame:
        return _first(keys.groupBy("shard", "k").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "shard", "first", slots)

    def fold(rows: DataFrame, earlier: DataFrame) -> DataFrame:
        keys = writes(rows).groupBy(F.pmod("k", F.lit(shards)).alias("shard"), "k").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
        queued = queue_of(earlier.where("k IS NOT NULL")).select("shard", "k", F.lit(True).alias("queued"))
        known = keys.join(queued, ["shard", "k"], "left")
        kept = known.where("queued").drop("queued").unionByName(_first(known.where("queued IS NULL").drop("queued"), "shard", "first", slots))
        return kept.unionByName(keys.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("first"), "n"))

    parts = folded(ops, fold, "shard long, k long, first long, n long", base)
    every = parts.where("k IS NULL").groupBy("shard").agg(F.sum("n").alias("writes"))
    queue = queue_of(parts.where("k IS NOT NULL")).groupBy("shard").agg(F.count("*").alias("queued"), F.sum("n").alias("taken"))
    return every.join(queue, "shard").select("shard", "queued", (F.col("taken") - F.col("queued")).alias("merged"), (F.col("writes") - F.col("taken")).alias("dropped"))


def reservoir(events: DataFrame, by: str, n: int, base: str | None = None) -> DataFrame:
    """event_id, by, value: the first n events of each group, whatever comes after."""
    fields = ["event_id", by, "value"]
    parts = folded(events, lambda rows, _: _first(rows.select(*fields), by, "event_id", n), f"event_id long, {by} string, value double", base)
    return _first(parts.select(*fields), by, "event_id", n)
