"""Queries that write and read files (CSV, TSV, key=value, operation files), counters, and generated values."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import scalars as S
from .operators import oplog, stats
from .queries import OPS, _ops
from .registry import query
from .sources import tables
from .sources.tables import scratch, table

# --------------------------------------------------------------------------
# Latency samples as CSV

_SAMPLES = """samples AS (SELECT ['lz4', 'qpl', 'zlib_accel'][user_id % 3 + 1] AS algorithm, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'landing' ELSE 'put' END AS op, event_id AS "index", CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 7919 % 100003)::DOUBLE END AS latency_ns FROM events)"""


def _latency_csv(spark, d) -> str:
    """A CSV file of samples; every 17th latency is no number."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "landing").otherwise("put")
    latency = F.when(F.col("event_id") % 17 == 0, "n/a").otherwise((F.col("event_id") * 7919 % 100003).cast("string"))
    path = scratch(spark)
    tables.write_latency_csv(e.select(S.codec_name(F.col("user_id") % 3).alias("algorithm"), op.alias("op"), F.col("event_id").alias("index"), latency.alias("latency_ns")), path)
    return path


@query(f'WITH {_SAMPLES} SELECT algorithm, op, "index", latency_ns FROM samples')
def latency_csv(spark, d):
    return tables.read_latency_csv(spark, _latency_csv(spark, d))


@query(f"WITH {_SAMPLES} SELECT algorithm, op, count(*) AS n, round(avg(latency_ns), 6) AS avg_value, round(quantile_cont(latency_ns, 0.5), 6) AS p50, round(quantile_cont(latency_ns, 0.9), 6) AS p90, round(quantile_cont(latency_ns, 0.99), 6) AS p99, max(latency_ns) AS max_value FROM samples WHERE latency_ns IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2")
def latency_csv_summary(spark, d):
    """The summary by algorithm and operation, in this order; what is no number is passed over."""
    p = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    out = stats.latency_summary(tables.read_latency_csv(spark, _latency_csv(spark, d)), ["algorithm", "op"], "latency_ns", p)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_value", *p)}).orderBy("algorithm", "op")


@query(f"WITH {_SAMPLES}, s AS (SELECT op, latency_ns, row_number() OVER (PARTITION BY op ORDER BY latency_ns) - 1 AS r, count(*) OVER (PARTITION BY op) AS n FROM samples WHERE latency_ns IS NOT NULL) SELECT op, min(latency_ns) AS p99 FROM s WHERE r = least(floor(0.99 * n), n - 1) GROUP BY op")
def latency_p99_whole(spark, d):
    """The other nearest rank: the whole part of 0.99 n."""
    samples = tables.read_latency_csv(spark, _latency_csv(spark, d))
    return stats.nearest_rank(samples, "op", "latency_ns", whole=True).withColumnRenamed("p", "p99")


# --------------------------------------------------------------------------
# Summaries as TSV, metrics as key=value


@query("SELECT event_type AS run, CASE WHEN event_type = 'view' THEN NULL ELSE count(*)::VARCHAR END AS ops, round(avg(value), 3)::DECIMAL(18, 3)::VARCHAR AS mean FROM events GROUP BY event_type")
def summary_tsv(spark, d):
    """A summary written as TSV, with NA for what is missing, and read again."""
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").cast("string").alias("ops"), F.round(F.avg("value"), 3).cast("decimal(18,3)").cast("string").alias("mean"))
    path = scratch(spark)
    tables.write_tsv(n.withColumn("ops", F.when(F.col("run") != "view", F.col("ops"))), path)
    return tables.read_tsv(spark, path).select("run", "ops", "mean")


@query("WITH w AS (SELECT unnest(['user_sec', 'sys_sec', 'wall_sec', 'idle_sec']) AS name, unnest([0, 1, 2, 9]) AS i), m AS (SELECT event_id % 5 AS i, floor(arg_min(value, event_id))::BIGINT AS v FROM events GROUP BY 1) SELECT name, coalesce(v::VARCHAR, 'NA') AS value FROM w LEFT JOIN m ON w.i = m.i")
def metric_lookup(spark, d):
    """The first line of each name in a file of name=value lines, else NA."""
    names = ["user_sec", "sys_sec", "wall_sec", "a", "b"]
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int")).alias("name"), F.floor("value").alias("value"))
    path = scratch(spark)
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.concat_ws("=", "name", F.col("value").cast("string"))).write.text(path)
    found = tables.key_values(tables.read_lines(spark, path))
    wanted = spark.createDataFrame([(n,) for n in ("user_sec", "sys_sec", "wall_sec", "idle_sec")], "name string")
    return wanted.join(found, "name", "left").select("name", F.coalesce("value", F.lit("NA")).alias("value"))


@query("WITH m AS (SELECT event_type AS run, count(*) AS ops, (count(*) % 97 + 3)::DOUBLE AS wall, (count(*) % 31)::DOUBLE AS user_s, (count(*) % 7)::DOUBLE AS sys_s FROM events GROUP BY 1) SELECT run, round(ops / wall, 6) AS qps, round((user_s + sys_s) / wall, 6) AS cores, round(CASE WHEN user_s + sys_s > 0 THEN (ops / wall) / ((user_s + sys_s) / wall) ELSE 0 END, 6) AS qps_per_core FROM m")
def throughput(spark, d):
    n = F.count("*")
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(n.alias("ops"), (n % 97 + 3).cast("double").alias("wall"), (n % 31).cast("double").alias("user_s"), (n % 7).cast("double").alias("sys_s"))
    return stats.efficiency(m).select("run", *[F.round(c, 6).alias(c) for c in ("qps", "cores", "qps_per_core")])


@query("WITH f AS (SELECT 'region=' || n_regionkey AS file, string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey) SELECT file, octet_length(encode(body))::BIGINT AS size, i AS slice, md5(substr(body, i * 16 + 1, 16)) AS digest FROM (SELECT file, body, unnest(generate_series(0, length(body) // 16 - 1)) AS i FROM f)")
def binary_slices(spark, d):
    """Files read as bytes and cut to whole slices, the rest of a file dropped."""
    n = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"), F.col("n_regionkey").alias("region"), "n_nationkey")
    path = scratch(spark)
    n.repartition("region").sortWithinPartitions("region", "n_nationkey").select("line", "region").write.partitionBy("region").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    whole = files.select(F.regexp_extract("path", "region=[^/]*", 0).alias("file"), F.col("length").alias("size"), "content")
    parts = whole.select("file", "size", "content", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / 16) - 1).cast("int"))).alias("slice"))
    return parts.select("file", "size", F.col("slice").cast("long").alias("slice"), F.md5(F.expr("substring(content, slice * 16 + 1, 16)")).alias("digest"))


# --------------------------------------------------------------------------
# Operation files

_FILE = """g AS (SELECT event_id, (event_id * 1103515245 + 12345) % 2147483648 AS x FROM events), f AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, CASE WHEN (x // 65536) % 100 < 30 THEN 'i' WHEN (x // 65536) % 100 < 60 THEN 'r' ELSE 's' END AS op, x % 500 + 1 AS p, (x // 512) % 500 + 1 AS q FROM g),
ops AS (SELECT seq, op, CASE WHEN op = 'r' THEN least(p, q) ELSE p END AS a, CASE WHEN op = 'r' THEN greatest(p, q) END AS b FROM f)"""


def _op_file(spark, d):
    """30 % inserts, 30 % ranges with lo <= hi, 40 % searches, and a last line "q", written and read again."""
    x = (F.col("event_id") * 1103515245 + 12345) % 2147483648
    g = table(spark, d, "events").select("event_id", x.alias("x"))
    r = F.floor(F.col("x") / 65536) % 100
    p, q = F.col("x") % 500 + 1, F.floor(F.col("x") / 512) % 500 + 1
    op = F.when(r < 30, "i").when(r < 60, "r").otherwise("s")
    ops = g.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "r", F.least(p, q)).otherwise(p).alias("a"), F.when(op == "r", F.greatest(p, q)).alias("b"))
    path = scratch(spark)
    tables.write_op_file(ops, path)
    return tables.read_op_file(spark, path)


@query(f"WITH {_FILE} SELECT seq, op, a, b FROM ops")
def op_file(spark, d):
    return _op_file(spark, d)


@query(f"WITH {_FILE}, i AS (SELECT a AS k, min(seq) AS first FROM ops WHERE op = 'i' GROUP BY a) SELECT ops.seq, ops.a AS k, coalesce(i.first < ops.seq, false) AS found FROM ops LEFT JOIN i ON ops.a = i.k WHERE ops.op = 's'")
def op_file_replay(spark, d):
    """Searches of a replayed file: has the key been inserted before?"""
    ops = _op_file(spark, d).where("op != 'r'").select("seq", F.col("a").alias("k"), F.when(F.col("op") == "i", "put").otherwise("get").alias("op"))
    return oplog.present_before(ops).where("op = 'get'").select("seq", "k", F.col("present").alias("found"))


@query("""SELECT event_id AS seq, i AS at, (event_id * (i + 3)) % 1000 AS size FROM events, (SELECT unnest(generate_series(0, 4)) AS i) WHERE i < event_id % 5""")
def json_array(spark, d):
    """The numbers of an array in a JSON text, by its key, with their places."""
    own = table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN array() ELSE transform(sequence(0, CAST(event_id % 5 AS int) - 1), i -> (event_id * (i + 3)) % 1000) END").alias("sizes"))
    text = own.select("event_id", F.to_json(F.struct(F.lit("get").alias("op"), "sizes")).alias("text"))
    return text.select(F.col("event_id").alias("seq"), F.posexplode(F.from_json("text", "sizes array<long>")["sizes"]).alias("at", "size")).withColumn("at", F.col("at").cast("long"))


# --------------------------------------------------------------------------
# Counters


@query(f"""WITH {OPS}, o AS (SELECT *, ((k % 8) + 8) % 8 AS shard, k % 3 AS codec FROM ops WHERE op IN ('put', 'delete')), e AS (SELECT shard, k, count(*) AS n, min(seq) AS first FROM o GROUP BY shard, k)
SELECT shard, sum(n)::BIGINT AS offered, count(*) AS enqueued, (sum(n) - count(*))::BIGINT AS merged, count(*) FILTER (n >= 15) AS compacted, count(*) FILTER (n < 15) AS skipped FROM e GROUP BY shard""")
def background_counters(spark, d):
    """Counters of background compaction, a shard each: keys offered, enqueued, merged with queued ones, compacted, and skipped as not full enough."""
    keys = oplog.writes(_ops(spark, d)).groupBy(S.shard_of(F.col("k"), DEFAULT.shards).alias("shard"), "k").agg(F.count("*").alias("n"))
    return keys.groupBy("shard").agg(F.sum("n").alias("offered"), F.count("*").alias("enqueued"), (F.sum("n") - F.count("*")).alias("merged"), F.count_if(F.col("n") >= 15).alias("compacted"), F.count_if(F.col("n") < 15).alias("skipped"))


@query(f"""WITH {OPS}, o AS (SELECT ((k % 8) + 8) % 8 AS shard, op, (k % 3)::INTEGER AS codec, seq % 50 = 0 AS failed FROM ops)
SELECT shard, ['lz4', 'qpl', 'zlib_accel'][codec + 1] AS codec, count(*) FILTER (op = 'put') AS compress_calls, count(*) FILTER (op IN ('get', 'range')) AS decompress_calls, count(*) FILTER (op = 'put' AND failed) AS fallbacks, count(*) FILTER (op IN ('get', 'range') AND failed) AS errors FROM o GROUP BY shard, codec""")
def codec_counters(spark, d):
    put, read, failed = F.col("op") == "put", F.col("op").isin("get", "range"), F.col("seq") % 50 == 0
    own = _ops(spark, d).groupBy(S.shard_of(F.col("k"), DEFAULT.shards).alias("shard"), S.codec_name(F.col("k") % 3).alias("codec"))
    return own.agg(F.count_if(put).alias("compress_calls"), F.count_if(read).alias("decompress_calls"), F.count_if(put & failed).alias("fallbacks"), F.count_if(read & failed).alias("errors"))


# --------------------------------------------------------------------------
# Generated values and predicates


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey * 1009 + o_custkey % 5 + 1 = 0 THEN 1 ELSE o_orderkey * 1009 + o_custkey % 5 + 1 END AS next_value, o_orderkey * 7 + 42 AS value_for_key, o_orderkey * 17 + (o_custkey % 5) * 100000 + 1 AS stored_value, o_orderkey + 1000 AS expected_value FROM orders")
def generated_values(spark, d):
    k, version = F.col("o_orderkey"), F.col("o_custkey") % 5
    return table(spark, d, "orders").select(k.alias("k"), S.next_value(k, version).alias("next_value"), (k * 7 + 42).alias("value_for_key"), (k * 17 + version * 100000 + 1).alias("stored_value"), (k + 1000).alias("expected_value"))


_READ = "v AS (SELECT event_id AS seq, user_id AS k, user_id + event_id % 5 - 2 AS hi, CASE event_id % 4 WHEN 0 THEN -1 ELSE user_id * 1009 + event_id % 4 END AS value FROM events)"


@query(f"WITH {_READ} SELECT seq, value = -1 OR value > k * 1009 + 1 AS plausible, value = -1 OR EXISTS (SELECT 1 FROM generate_series(k, hi) t(x) WHERE value > x * 1009 + 1) AS plausible_in_range FROM v")
def plausible_values(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), (F.col("user_id") + F.col("event_id") % 5 - 2).alias("hi"), F.when(F.col("event_id") % 4 == 0, -1).otherwise(F.col("user_id") * 1009 + F.col("event_id") % 4).alias("value"))
    return e.select("seq", S.plausible(F.col("k"), F.col("value")).alias("plausible"), S.plausible_in(F.col("k"), F.col("hi"), F.col("value")).alias("plausible_in_range"))


@query("SELECT event_id AS seq, epoch_us(ts) AS micros, (event_id * 1000 + 999) // 1000 AS elapsed_us FROM events")
def timestamps(spark, d):
    """Microseconds since 1970, and elapsed nanoseconds as whole microseconds."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.floor((F.col("event_id") * 1000 + 999) / 1000).alias("elapsed_us"))


@query("SELECT event_id AS seq, hex(encode(left(props, 7))) AS copied, CASE WHEN octet_length(encode(props)) >= 8 THEN -1 ELSE 0 END AS status FROM events")
def safe_copies(spark, d):
    copied, status = S.safe_copy(F.col("props"), 8)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.hex(copied).alias("copied"), status.alias("status"))


@query("SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'lz4' WHEN 1 THEN 'qpl' WHEN 2 THEN 'zlib_accel' ELSE 'unknown' END AS codec FROM events")
def codec_names(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), S.codec_name(F.col("event_id") % 5).alias("codec"))
