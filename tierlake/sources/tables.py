"""Sources and sinks: tables, the operation log, logs, TSV, CSV and JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENCY_CSV = "algorithm string, op string, index long, latency_ns string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operations(events: DataFrame) -> DataFrame:
    """seq, k, v, op, ts: events as an operation log."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "range").otherwise("put")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("value").alias("v"), op.alias("op"), "ts")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir; set here only where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tierlake-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write df to a shared table and read it back: what is worked out once, and what lost executors start from."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_latency_csv(spark: SparkSession, path: str) -> DataFrame:
    """algorithm, op, index, latency_ns (null where it is no number)."""
    return spark.read.schema(LATENCY_CSV).csv(path, header=True).withColumn("latency_ns", F.col("latency_ns").try_cast("double"))


def write_latency_csv(df: DataFrame, path: str) -> None:
    df.select("algorithm", "op", "index", "latency_ns").write.csv(path, header=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, nullValue="NA")


def key_values(lines: DataFrame) -> DataFrame:
    """name, value: the first line of each name in "name=value" lines (columns: no, value)."""
    parts = F.split("value", "=", 2)
    own = lines.where(F.col("value").contains("=")).select("no", parts[0].alias("name"), parts[1].alias("text"))
    return own.groupBy("name").agg(F.min_by("text", "no").alias("value"))


def log_field(line, name: str):
    """The value of name=... in a log line, else NA."""
    got = F.regexp_extract(line, rf"(?:^|\s){name}=(\S+)", 1)
    return F.when(got == "", "NA").otherwise(got)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """no (from 0, in the order of the files and their lines), value. Files are split and read apart; places put the lines in order again."""
    from ..plans.prefix import numbered

    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return numbered(settle(lines), ["file", "start", "at"], "no").select("no", "value")


def write_op_file(ops: DataFrame, path: str) -> None:
    """ops (seq, op, a, b) as lines "i a", "s a" or "r a b", in the order of seq, and a last "q"."""
    last = ops.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq")).select("seq", F.lit("q").alias("line"))
    line = F.concat_ws(" ", "op", F.col("a").cast("string"), F.when(F.col("op") == "r", F.col("b").cast("string")))
    both = ops.select("seq", line.alias("line")).unionByName(last)
    both.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.text(path)


def read_op_file(spark: SparkSession, path: str) -> DataFrame:
    """seq (the line's number), op, a, b (null but for ranges): the lines before the first "q"."""
    lines = read_lines(spark, path)
    end = lines.where("value = 'q'").agg(F.min("no").alias("end"))
    parts = F.split("value", " ")
    before = lines.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.col("no") < F.col("end")))  # one row
    return before.select(F.col("no").alias("seq"), parts[0].alias("op"), F.get(parts, 1).cast("long").alias("a"), F.get(parts, 2).cast("long").alias("b"))
