"""Every query by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import scalars as S
from .operators import codec, evict, lookup, objects, oplog, pages, stats
from .plans.prefix import nearest_below
from .registry import ORACLE_SQL, QUERIES, query
from .sources.tables import log_field, operations, table
from .streaming import jobs

OPS = """ops AS (SELECT event_id AS seq, user_id AS k, value AS v, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' WHEN 'click' THEN 'range' ELSE 'put' END AS op FROM events)"""
LWW = """lww AS (SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM ops WHERE op IN ('put', 'delete')) WHERE r = 1 AND op <> 'delete')"""
#: 150 ranges over the whole span of order keys, every third one with swapped bounds.
RANGES = """span AS (SELECT max(o_orderkey) // 150 + 1 AS w FROM orders), bounds AS (SELECT i AS id, i * w AS near, i * w + (i * 131) % 400 AS far FROM span, generate_series(0, 149) t(i)), ranges AS (SELECT id, CASE WHEN id % 3 = 0 THEN far ELSE near END AS lo, CASE WHEN id % 3 = 0 THEN near ELSE far END AS hi FROM bounds)"""


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return operations(table(spark, d, "events"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    span = _orders(spark, d).agg((F.floor(F.max("k") / 150) + 1).alias("w"))
    i, swapped = F.col("id"), F.col("id") % 3 == 0
    bounds = spark.range(150).crossJoin(F.broadcast(span)).select("id", (i * F.col("w")).alias("near"), (i * F.col("w") + i * 131 % 400).alias("far"))  # one row
    return bounds.select("id", F.when(swapped, F.col("far")).otherwise(F.col("near")).alias("lo"), F.when(swapped, F.col("near")).otherwise(F.col("far")).alias("hi"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text", F.octet_length("text").cast("long").alias("size"))


_SIZES = "objects AS (SELECT doc_id AS seq, text, octet_length(encode(text))::BIGINT AS size FROM documents)"


def _tier_sql(size: str) -> str:
    return f"CASE WHEN {size} <= 128 THEN 'TINY' WHEN {size} <= 2048 THEN 'MEDIUM' WHEN {size} IS NOT NULL THEN 'LARGE' ELSE 'UNKNOWN' END"


# --------------------------------------------------------------------------
# Operation log


@query(f"WITH {OPS}, {LWW} SELECT k, seq, v FROM lww")
def oplog_lww_state(spark, d):
    return oplog.last_wins(_ops(spark, d))


@query(f"WITH {OPS} SELECT k, min(seq) AS seq, arg_min(v, seq) AS v FROM ops WHERE op = 'put' GROUP BY k")
def oplog_first_wins(spark, d):
    return oplog.first_wins(_ops(spark, d))


@query(f"""WITH {OPS}, w AS (SELECT * FROM ops WHERE op IN ('put', 'delete')), g AS (SELECT seq, k FROM ops WHERE op = 'get')
SELECT g.seq, g.k, coalesce(w.op = 'put', false) AS found, CASE WHEN w.op = 'put' THEN w.v END AS v FROM g ASOF LEFT JOIN w ON g.k = w.k AND g.seq > w.seq""")
def oplog_asof_get(spark, d):
    return oplog.reads_along(_ops(spark, d))


@query(f"""WITH {OPS}, p AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('put', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS present FROM ops WHERE op <> 'range')
SELECT op, count(*) AS n, count(*) FILTER (CASE WHEN op = 'put' THEN NOT present ELSE present END) AS effective FROM p GROUP BY op""")
def existence_replay(spark, d):
    return oplog.replay(_ops(spark, d))


@query(f"""WITH {OPS}, o AS (SELECT *, ((k % 8) + 8) % 8 AS shard FROM ops WHERE op IN ('put', 'delete')),
e AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY seq) - 1) // 3 AS epoch FROM o)
SELECT shard, epoch, count(*) AS absorbed, count(DISTINCT k) AS compacted, max(seq) AS last_seq FROM e GROUP BY shard, epoch""")
def landing_epochs(spark, d):
    return oplog.landing_epochs(_ops(spark, d), DEFAULT.shards, DEFAULT.landing_slots)


@query("""WITH a AS (SELECT user_id AS k, event_id AS seq, value AS v FROM events), levels AS (
  SELECT k, arg_max(v, seq) AS v, 0 AS level FROM a WHERE seq % 2 = 0 GROUP BY k UNION ALL SELECT k, arg_max(v, seq) AS v, 1 AS level FROM a WHERE seq % 2 = 1 GROUP BY k)
SELECT k, arg_max(v, level) AS v, max(level) AS level FROM levels GROUP BY k""")
def merge_on_read(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    level = lambda df: df.groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    return oplog.merge_levels(level(events.where("seq % 2 = 0")), level(events.where("seq % 2 = 1")))


@query(f"WITH {OPS} SELECT k, min(seq) AS first_seq FROM ops WHERE op IN ('put', 'delete') GROUP BY k ORDER BY first_seq LIMIT 4096")
def dirty_queue_dedup(spark, d):
    return oplog.dirty_keys(_ops(spark, d), DEFAULT.queue_slots)


@query(f"""WITH {OPS}, e AS (SELECT k, count(*) FILTER (op IN ('put', 'delete')) AS landing, max(seq) AS last_seq FROM ops GROUP BY k)
SELECT k, landing % 16 AS landing, last_seq FROM e WHERE (landing % 16) * 100 >= 15 * 75 ORDER BY last_seq LIMIT 128""")
def compaction_candidates(spark, d):
    leaves = _ops(spark, d).groupBy("k").agg(F.count_if(F.col("op").isin("put", "delete")).alias("landing"), F.max("seq").alias("last_seq"))
    full = leaves.withColumn("landing", F.col("landing") % 16).where(F.col("landing") * 100 >= 15 * DEFAULT.compact_percent)
    return full.orderBy("last_seq").limit(DEFAULT.leaves_per_pass)


@query(f"""WITH {OPS}, {LWW}, g AS (SELECT k, min(seq) AS seq FROM ops WHERE op = 'get' GROUP BY k), d AS (SELECT k, max(seq) AS seq FROM ops WHERE op = 'delete' GROUP BY k),
first AS (SELECT o.k, min(o.seq) AS seq FROM ops o JOIN d ON o.k = d.k AND o.seq > d.seq WHERE o.op = 'get' GROUP BY o.k)
SELECT first.k, first.seq, lww.v FROM first JOIN lww ON first.k = lww.k""")
def promotion_first_hit(spark, d):
    ops = _ops(spark, d)
    down = ops.where("op = 'delete'").groupBy("k").agg(F.max("seq").alias("down"))
    first = ops.where("op = 'get'").join(down, "k").where("seq > down").groupBy("k").agg(F.min("seq").alias("seq"))
    return first.join(oplog.last_wins(ops).select("k", "v"), "k").select("k", "seq", "v")


@query("""WITH g AS (SELECT event_id, (event_id * 1103515245 + 12345) % 2147483648 AS a FROM events), h AS (SELECT *, (a // 65536) % 100 AS r, (a // 1024) % 100 AS s, a % 1000 AS u FROM g),
p AS (SELECT event_id AS seq, CASE WHEN r < 50 THEN 'read' WHEN r < 85 THEN 'write' WHEN r < 95 THEN 'delete' ELSE 'scan' END AS op, CASE WHEN s < 80 THEN u % 100 ELSE u END + 1 AS key, event_id % 7 AS version FROM h)
SELECT seq, op, key, key * 1009 + version + 1 AS value FROM p""")
def oplog_generate(spark, d):
    a = (F.col("event_id") * 1103515245 + 12345) % 2147483648
    g = table(spark, d, "events").select("event_id", a.alias("a"))
    r, s, u = F.floor(F.col("a") / 65536) % 100, F.floor(F.col("a") / 1024) % 100, F.col("a") % 1000
    op = F.when(r < 50, "read").when(r < 85, "write").when(r < 95, "delete").otherwise("scan")
    key = F.when(s < 80, u % 100).otherwise(u) + 1
    return g.select(F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), (key * 1009 + F.col("event_id") % 7 + 1).alias("value"))


@query(f"WITH {OPS} SELECT op, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ops), 6) AS percent FROM ops GROUP BY op")
def workload_mix(spark, d):
    ops = _ops(spark, d)
    counts = ops.groupBy("op").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("op", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # one row


@query(f"""WITH {OPS}, p AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('put', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS present FROM ops)
SELECT ((k % 8) + 8) % 8 AS shard, count(*) AS gets, count(*) FILTER (present) AS hits, count(*) FILTER (NOT present) AS misses, round(count(*) FILTER (present) * 100.0 / count(*), 6) AS hit_percent FROM p WHERE op = 'get' GROUP BY 1""")
def hit_rates(spark, d):
    seen = oplog.reads_along(_ops(spark, d)).withColumn("shard", S.shard_of(F.col("k"), DEFAULT.shards))
    counts = seen.groupBy("shard").agg(F.count("*").alias("gets"), F.count_if("found").alias("hits"), F.count_if(~F.col("found")).alias("misses"))
    return counts.withColumn("hit_percent", F.round(F.col("hits") * 100.0 / F.col("gets"), 6))


# --------------------------------------------------------------------------
# Lookups


@query(f"""WITH {OPS}, {LWW}, p AS (SELECT DISTINCT user_id + 7 AS k FROM events UNION SELECT DISTINCT user_id FROM events) SELECT p.k, coalesce(lww.v, -1.0) AS v FROM p LEFT JOIN lww ON p.k = lww.k""")
def point_lookup_left(spark, d):
    ops = _ops(spark, d)
    probes = ops.select(F.explode(F.array("k", F.col("k") + 7)).alias("k")).distinct()
    return lookup.points(probes, oplog.last_wins(ops))


@query(f"WITH {RANGES} SELECT max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderkey BETWEEN least(900, 100) AND greatest(900, 100)")
def range_last_value(spark, d):
    lo, hi = sorted((900, 100))
    return _orders(spark, d).where(F.col("k").between(lo, hi)).agg(F.max("k").alias("k"), F.max_by("v", "k").alias("v"))


@query(f"WITH {RANGES} SELECT id, arg_max(o_totalprice, o_orderkey) AS v FROM ranges LEFT JOIN orders ON o_orderkey BETWEEN least(lo, hi) AND greatest(lo, hi) GROUP BY id")
def range_last_batch(spark, d):
    return lookup.last_in(_ranges(spark, d), _orders(spark, d))


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey BETWEEN 20 AND 700 ORDER BY o_orderkey LIMIT 50")
def range_rows_limit(spark, d):
    return _orders(spark, d).where(F.col("k").between(20, 700)).orderBy("k").limit(50)


@query(f"WITH {RANGES} SELECT id, lo, hi FROM ranges WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey BETWEEN lo AND hi)")
def range_membership_semi(spark, d):
    return lookup.ranges_with(_ranges(spark, d), _orders(spark, d))


@query(f"""WITH {RANGES} SELECT id, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN lo AND hi) AS n_strict, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN least(lo, hi) AND greatest(lo, hi)) AS n_swapped FROM ranges""")
def range_bounds_reversed(spark, d):
    ranges, orders = _ranges(spark, d), _orders(spark, d)
    return lookup.counts_in(ranges, orders, "n_strict").join(lookup.counts_in(lookup.normalised(ranges), orders, "n_swapped"), "id")


@query(f"WITH {RANGES}, b AS (SELECT unnest(generate_series(0, 15)) AS bucket) SELECT id, count(*) AS buckets FROM ranges, b WHERE EXISTS (SELECT 1 FROM generate_series(least(lo, hi), greatest(lo, hi)) t(x) WHERE x % 16 = bucket) GROUP BY id")
def bucket_prune(spark, d):
    meets = F.explode(F.filter(F.sequence(F.lit(0), F.lit(DEFAULT.buckets - 1)), lambda b: lookup.bucket_meets(F.col("lo"), F.col("hi"), b, DEFAULT.buckets)))
    return _ranges(spark, d).select("id", meets.alias("bucket")).groupBy("id").agg(F.count("*").alias("buckets"))


_TIERS = f"""t AS (SELECT seq AS k, size AS v, {_tier_sql('size')} AS tier FROM objects)"""


def _tiers(spark, d):
    return _objects(spark, d).select(F.col("seq").alias("k"), F.col("size").alias("v"), S.tier_of(F.col("size")).alias("tier"))


@query(f"WITH {_SIZES} SELECT tier, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT size, {_tier_sql('size')} AS tier FROM objects) GROUP BY tier")
def tier_classify(spark, d):
    return _objects(spark, d).groupBy(S.tier_of(F.col("size")).alias("tier")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {_SIZES}, {_TIERS}, every AS (SELECT k, v, tier, 0 AS p FROM t WHERE tier <> 'LARGE' AND k % 3 <> 0 UNION ALL SELECT k, v, tier, 1 FROM t WHERE tier = 'LARGE' UNION ALL SELECT k, -v, 'SSD', 2 FROM t)
SELECT k, arg_min(tier, p) AS tier, arg_min(v, p) AS v FROM every GROUP BY k""")
def tier_priority_lookup(spark, d):
    t = _tiers(spark, d)
    return lookup.newest_tier(t.where("tier != 'LARGE' AND k % 3 != 0"), t.where("tier = 'LARGE'"), t.select("k", (-F.col("v")).alias("v"), F.lit("SSD").alias("tier")))


_PUTS = "w AS (SELECT doc_id % 97 AS k, doc_id AS seq, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)"


def _puts(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 97).alias("k"), F.col("doc_id").alias("seq"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


@query(f"""WITH {_PUTS}, l AS (SELECT k, max(seq) AS seq, arg_max(size, seq) AS size, max(CASE WHEN size > 2048 THEN seq END) AS last_large FROM w WHERE size > 0 GROUP BY k)
SELECT k, seq, CASE WHEN size <= 2048 THEN 'DRAM' ELSE 'LO' END AS tier, size > 2048 AS tombstone_in_dram, coalesce(last_large < seq, false) AS stale_large_removed FROM l""")
def tombstone_shadow(spark, d):
    large = F.col("size") > DEFAULT.medium
    last = _puts(spark, d).where("size > 0").groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("size", "seq").alias("size"), F.max(F.when(large, F.col("seq"))).alias("last_large"))
    return last.select("k", "seq", F.when(large, "LO").otherwise("DRAM").alias("tier"), large.alias("tombstone_in_dram"), F.coalesce(F.col("last_large") < F.col("seq"), F.lit(False)).alias("stale_large_removed"))


@query(f"WITH {_PUTS} SELECT count(*) FILTER (size BETWEEN 1 AND 128) AS puts_tiny, count(*) FILTER (size BETWEEN 129 AND 2048) AS puts_medium, count(*) FILTER (size > 2048) AS puts_large, count(*) FILTER (size > 2048) AS tombstones, coalesce(sum(size) FILTER (size <= 2048), 0)::BIGINT AS memory_used FROM w WHERE size > 0")
def put_counters(spark, d):
    tier = S.tier_of(F.col("size"))
    of = lambda t: F.count_if(tier == t)
    used = F.coalesce(F.sum(F.when(tier != "LARGE", F.col("size"))), F.lit(0))
    return _puts(spark, d).where("size > 0").agg(of("TINY").alias("puts_tiny"), of("MEDIUM").alias("puts_medium"), of("LARGE").alias("puts_large"), of("LARGE").alias("tombstones"), used.alias("memory_used"))


@query(f"""WITH {OPS}, {LWW}, x AS (SELECT k, arg_max(v, seq) AS v FROM ops WHERE op = 'put' GROUP BY k)
SELECT count(*) FILTER (lww.k IS NOT NULL AND lww.v = x.v) AS correct, count(*) FILTER (lww.k IS NULL) AS missing, count(*) FILTER (lww.k IS NOT NULL AND lww.v IS DISTINCT FROM x.v) AS wrong FROM x FULL JOIN lww ON x.k = lww.k""")
def verify_counts(spark, d):
    ops = _ops(spark, d)
    expected = ops.where("op = 'put'").groupBy("k").agg(F.max_by("v", "seq").alias("want"))
    both = expected.join(oplog.last_wins(ops).withColumn("there", F.lit(True)), "k", "full_outer")
    there = F.coalesce("there", F.lit(False))
    return both.agg(F.count_if(there & (F.col("v") == F.col("want"))).alias("correct"), F.count_if(~there).alias("missing"), F.count_if(there & ~F.col("v").eqNullSafe(F.col("want"))).alias("wrong"))


# --------------------------------------------------------------------------
# Scalars

_BYTES = "list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT)"


@query(f"SELECT c_custkey AS k, list_reduce(list_prepend(2166136261::BIGINT, {_BYTES.format(x='c_name')}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash FROM customer")
def fnv1a_key(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), S.fnv1a32(F.col("c_name")).alias("hash"))


@query("""WITH a AS (SELECT o_orderkey AS k, ((o_orderkey & 4294967295)::HUGEINT * 2654435761 % 4294967296)::BIGINT AS h FROM orders), b AS (SELECT k, xor(h, h >> 16) AS h FROM a), c AS (SELECT k, xor(h, h >> 8) AS h FROM b) SELECT k, h % 16 AS bucket FROM c""")
def knuth_bucket(spark, d):
    return _orders(spark, d).select("k", S.knuth_bucket(F.col("k"), DEFAULT.buckets).alias("bucket"))


@query("SELECT ((k % 8) + 8) % 8 AS shard, count(*) AS n, min(k) AS least, max(k) AS greatest FROM (SELECT o_orderkey - 1000 AS k FROM orders) GROUP BY 1")
def pmod_shard(spark, d):
    k = _orders(spark, d).select((F.col("k") - 1000).alias("k"))
    return k.groupBy(S.shard_of(F.col("k"), DEFAULT.shards).alias("shard")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("greatest"))


@query("""WITH a AS (SELECT k, (k * 2654435761 % 4294967296)::BIGINT AS h FROM generate_series(1, 1000) t(k)), b AS (SELECT xor(h, h >> 16) AS h FROM a), c AS (SELECT xor(h, h >> 8) % 16 AS bucket FROM b), n AS (SELECT bucket, count(*) AS n FROM c GROUP BY bucket)
SELECT count(*) AS buckets, min(n) AS least, max(n) AS greatest, round((max(n) - min(n)) / (1000 / 16), 6) AS variation, (max(n) - min(n)) / (1000 / 16) < 0.5 AS even FROM n""")
def hash_quality(spark, d):
    n = spark.range(1, 1001).groupBy(S.knuth_bucket(F.col("id"), DEFAULT.buckets).alias("bucket")).agg(F.count("*").alias("n"))
    spread = (F.max("n") - F.min("n")) / F.lit(1000 / DEFAULT.buckets)
    return n.agg(F.count("*").alias("buckets"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(spread, 6).alias("variation"), (spread < 0.5).alias("even"))


def _fold(seed: int, step: str, finish: str = "{f}") -> str:
    f = f"list_reduce(list_prepend({seed}::BIGINT, {_BYTES.format(x='text')}), lambda c, b: {step})"
    return f"SELECT doc_id, {finish.format(f=f)} AS checksum FROM documents"


def _checksums(spark, d, of):
    """As in its SQL, a null text has no bytes and keeps the fold's start."""
    return table(spark, d, "documents").select("doc_id", of(F.coalesce("text", F.lit(""))).alias("checksum"))


@query(_fold(0, "xor(xor((c << 1) & 4294967295, b), xor((c << 1) & 4294967295, b) >> 16)"))
def checksum_shift(spark, d):
    return _checksums(spark, d, S.checksum_shift)


@query(_fold(0, "xor(((c << 1) & 4294967295) | (c >> 31), b)"))
def checksum_rotl(spark, d):
    return _checksums(spark, d, S.checksum_rotate)


@query(_fold(0, "(c * 31 + b) & 2147483647", "CASE WHEN {f} = 0 THEN 1 ELSE {f} END"))
def hash31(spark, d):
    return _checksums(spark, d, S.hash31)


@query(_fold(5381, "(c * 33 + b) & 4294967295", "CASE WHEN {f} >= 2147483648 THEN 4294967296 - {f} ELSE {f} END + 1"))
def hash33(spark, d):
    return _checksums(spark, d, S.hash33)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'IO_ERROR' ELSE 'OK' END AS status FROM documents WHERE text IS NOT NULL")
def checksum_verify(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    stored = docs.select("doc_id", "text", F.crc32(F.encode("text", "UTF-8")).alias("checksum"))
    read = stored.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")))
    return read.select("doc_id", F.when(F.crc32(F.encode("text", "UTF-8")) == F.col("checksum"), "OK").otherwise("IO_ERROR").alias("status"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 5 END AS stored, rpad(left(props, 128), 128, '~') AS payload, least(length(props), 128) AS used FROM events""")
def payload_normalize(spark, d):
    e = table(spark, d, "events")
    whole = S.payload(F.col("props"))
    shown = F.translate(whole.cast("string"), "\x00", "~")
    return e.select(F.col("event_id").alias("seq"), S.stored_value(F.col("event_id") % 5).alias("stored"), shown.alias("payload"), F.least(F.octet_length("props"), F.lit(DEFAULT.payload_bytes)).alias("used"))


@query("""WITH p AS (SELECT event_id, (event_id % 3)::INTEGER AS request, (event_id % 4)::INTEGER AS tier FROM events) SELECT event_id AS seq, ((request << 4) | tier)::INTEGER AS packed, request, tier FROM p""")
def record_nibbles(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("seq"), S.pack_record((F.col("event_id") % 3).cast("int"), (F.col("event_id") % 4).cast("int")).alias("packed"))
    return p.select("seq", "packed", S.request_of(F.col("packed")).alias("request"), S.record_tier(F.col("packed")).alias("tier"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '12' WHEN 1 THEN 'x' WHEN 2 THEN '99999' ELSE 'on' END AS t FROM events) SELECT event_id AS seq, coalesce(CASE WHEN try_cast(t AS INTEGER) BETWEEN 1 AND 1024 THEN try_cast(t AS INTEGER) END, 1) AS shards, lower(trim(t)) IN ('1', 'true', 'yes', 'on') AS enabled FROM s""")
def setting_parse(spark, d):
    n = F.col("event_id") % 4
    t = F.when(n == 0, "12").when(n == 1, "x").when(n == 2, "99999").otherwise("on")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), S.clamped_int(t, 1, 1024, 1).alias("shards"), S.flag(t).alias("enabled"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR octet_length(encode(text)) = 0 THEN 'ERROR' WHEN octet_length(encode(source || repeat('k', (doc_id % 300)::INTEGER))) > 256 THEN 'INVALID_SIZE' ELSE 'OK' END AS status FROM documents""")
def put_validate(spark, d):
    key = F.concat("source", F.repeat(F.lit("k"), (F.col("doc_id") % 300).cast("int")))
    return table(spark, d, "documents").select("doc_id", S.put_status(key, F.octet_length("text")).alias("status"))


# --------------------------------------------------------------------------
# Pages and objects


@query(f"WITH {_SIZES}, a AS (SELECT seq, size, (size + 4095) // 4096 * 4096 AS aligned FROM objects WHERE size > 2048) SELECT seq, size, aligned, coalesce(sum(aligned) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lba FROM a")
def lba_allocate(spark, d):
    return objects.appended(_objects(spark, d).drop("text").where(F.col("size") > DEFAULT.medium), DEFAULT.alignment)


@query(f"WITH {_SIZES} SELECT seq, size, row_number() OVER (ORDER BY seq) AS lba FROM objects")
def lo_allocate(spark, d):
    return objects.counted(_objects(spark, d).drop("text"))


@query(f"WITH {_SIZES} SELECT count(*) AS entries, sum(size)::BIGINT AS total_size, round(sum(size) / count(*), 6) AS average FROM objects WHERE size > 2048")
def lo_stats(spark, d):
    big = _objects(spark, d).where(F.col("size") > DEFAULT.medium)
    return big.agg(F.count("*").alias("entries"), F.sum("size").alias("total_size"), F.round(F.try_divide(F.sum("size"), F.count("*")), 6).alias("average"))


@query("WITH n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 30 AS leaf FROM orders) SELECT leaf, count(*) AS n, min(k) AS least, max(k) AS greatest FROM n GROUP BY leaf")
def leaf_pack(spark, d):
    return pages.separators(pages.packed(_orders(spark, d), DEFAULT.leaf_slots))


@query("""WITH n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 30 AS leaf FROM orders), r AS (SELECT leaf, k, row_number() OVER (PARTITION BY leaf ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY leaf) // 2 AS half FROM n)
SELECT leaf, min(k) FILTER (r >= half) AS separator, count(*) FILTER (r < half) AS n_left, count(*) FILTER (r >= half) AS n_right FROM r GROUP BY leaf""")
def leaf_split_median(spark, d):
    return pages.median_split(pages.packed(_orders(spark, d), DEFAULT.leaf_slots), "leaf")


@query("WITH n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 30 AS leaf FROM orders), s AS (SELECT leaf, min(k) AS separator FROM n GROUP BY leaf) SELECT leaf // 64 AS parent, count(*) AS children, min(separator) AS least FROM s GROUP BY parent")
def separators(spark, d):
    leaves = pages.separators(pages.packed(_orders(spark, d), DEFAULT.leaf_slots))
    return leaves.groupBy(F.floor(F.col("leaf") / 64).alias("parent")).agg(F.count("*").alias("children"), F.min("least").alias("least"))


@query("WITH b AS (SELECT o_orderkey % 512 AS bucket, least(count(*), 340) AS n FROM orders GROUP BY 1) SELECT bucket, n, 16 + n * 12 AS used, 4096 - (16 + n * 12) AS unused, round((4096 - (16 + n * 12)) * 100.0 / 4096, 6) AS unused_percent FROM b")
def page_space(spark, d):
    n = _orders(spark, d).groupBy(F.pmod("k", F.lit(512)).alias("bucket")).agg(F.least(F.count("*"), F.lit(DEFAULT.page_entries)).alias("n"))
    return pages.space(n, DEFAULT.page_entries)


@query(f"WITH {_SIZES}, p AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN 0 ELSE seq END AS lba, CASE WHEN seq % 10 = 0 THEN 0 ELSE size END AS size FROM objects) SELECT seq, lba, size FROM p WHERE lba <> 0 OR size <> 0")
def valid_pointer_filter(spark, d):
    zero = lambda n, c: F.when(F.col("seq") % n == 0, F.lit(0)).otherwise(F.col(c))
    p = _objects(spark, d).select("seq", zero(5, "seq").alias("lba"), zero(10, "size").alias("size"))
    return p.where(S.pointer_is_valid(F.col("lba"), F.col("size")))


@query("""WITH n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 30 AS leaf FROM orders), l AS (SELECT leaf, count(*) AS n, min(k) AS a, max(k) AS b FROM n GROUP BY leaf), o AS (SELECT *, lag(b) OVER (ORDER BY leaf) AS before FROM l)
SELECT count(*) AS leaves, sum(n)::BIGINT AS keys, bool_and(n BETWEEN 1 AND 30) AS filled, bool_and(before IS NULL OR before < a) AS ordered FROM o""")
def consistency_checks(spark, d):
    leaves = pages.separators(pages.packed(_orders(spark, d), DEFAULT.leaf_slots))
    follow = leaves.select((F.col("leaf") + 1).alias("leaf"), F.col("greatest").alias("before"))
    both = leaves.join(follow, "leaf", "left")
    return both.agg(F.count("*").alias("leaves"), F.sum("n").alias("keys"), F.bool_and(F.col("n").between(1, DEFAULT.leaf_slots)).alias("filled"), F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("least"))).alias("ordered"))


@query("SELECT doc_id, i AS chunk, substr(raw, i * 256 + 1, 256) AS body FROM (SELECT doc_id, raw, unnest(generate_series(0, length(raw) // 256 - 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS raw FROM documents) WHERE length(raw) >= 256)")
def slice_chunks(spark, d):
    """Whole slices of 128 bytes, in hex."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw")).where(F.octet_length("raw") >= 128)
    parts = docs.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), (F.floor(F.octet_length("raw") / 128) - 1).cast("int"))).alias("chunk"))
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.hex(F.expr("substring(raw, chunk * 128 + 1, 128)")).alias("body"))


# --------------------------------------------------------------------------
# Eviction


@query("""WITH p AS (SELECT user_id % 8 AS shard, user_id AS page, count(*) FILTER (event_type = 'view') % 2 = 1 AS accessed FROM events GROUP BY user_id), t AS (SELECT shard, page, row_number() OVER (PARTITION BY shard ORDER BY accessed, page) - 1 AS turn FROM p) SELECT shard, page, turn FROM t WHERE turn * 4096 < 10 * 4096""")
def eviction_clock(spark, d):
    p = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(DEFAULT.shards)).alias("shard"), F.col("user_id").alias("page")).agg((F.count_if(F.col("event_type") == "view") % 2 == 1).alias("accessed"))
    return evict.second_chance(p, 10 * 4096)


@query(f"""WITH {OPS}, p AS (SELECT seq, (abs(k) * 37 % 2000 + 1)::BIGINT AS size FROM ops WHERE op = 'put'), u AS (SELECT seq, size, sum(size) OVER (ORDER BY seq)::BIGINT AS used FROM p) SELECT seq, size, used, used >= 900000 AS evict FROM u""")
def eviction_watermark(spark, d):
    puts = _ops(spark, d).where("op = 'put'").select("seq", (F.abs("k") * 37 % 2000 + 1).alias("size"))
    return evict.pressure(puts, 1_000_000, DEFAULT.evict_at)


# --------------------------------------------------------------------------
# Statistics

_Q = ", ".join(f"quantile_cont(value, {x}) AS {n}" for n, x in stats.PERCENTILES.items())


@query(f"SELECT event_type AS op, count(*) AS n, avg(value) AS avg_value, {_Q}, max(value) AS max_value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, d):
    out = stats.latency_summary(table(spark, d, "events"), ["event_type"], "value").withColumnRenamed("event_type", "op")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_value", *stats.PERCENTILES)})


ORACLE_SQL["latency_percentiles"] = "SELECT op, n, max_value, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("avg_value", *stats.PERCENTILES)) + f" FROM ({ORACLE_SQL['latency_percentiles']})"


@query("""WITH s AS (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT op, min(value) AS p99 FROM s WHERE r = least(ceil(0.99 * n), n - 1) GROUP BY op""")
def latency_p99_nearest(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), "event_type", "value").select(F.col("event_type").alias("op"), F.col("p").alias("p99"))


@query(f"""WITH {_SIZES}, s AS (SELECT seq % 8 AS shard, size AS total, (size + 1) // 2 AS compressed FROM objects), g AS (SELECT shard, sum(total)::BIGINT AS total_bytes, sum(compressed)::BIGINT AS compressed_bytes FROM s GROUP BY shard)
SELECT *, round(CASE WHEN compressed_bytes > 0 THEN total_bytes / compressed_bytes ELSE 0.0 END, 6) AS ratio, round(CASE WHEN total_bytes > 0 THEN (1 - compressed_bytes / total_bytes) * 100 ELSE 0.0 END, 6) AS saved_pct FROM g""")
def compression_stats(spark, d):
    sizes = _objects(spark, d).select(F.pmod("seq", F.lit(DEFAULT.shards)).alias("shard"), F.col("size").alias("total"), F.floor((F.col("size") + 1) / 2).alias("compressed"))
    return codec.ratios(sizes, "shard")


@query()
def codec_stats(spark, d):
    packed = codec.size_after(6)(F.encode("text", "UTF-8"))
    sizes = _objects(spark, d).select(S.tier_of(F.col("size")).alias("tier"), F.col("size").alias("total"), packed.alias("compressed"))
    return codec.ratios(sizes, "tier")


@query("SELECT doc_id, true AS equal FROM documents")
def codec_round_trip(spark, d):
    docs = table(spark, d, "documents")
    raw = F.encode("text", "UTF-8")
    return docs.select("doc_id", (codec.decompress(codec.compressor(1)(raw)) == raw).alias("equal"))


_CDF = """b AS (SELECT p_size AS bucket, count(*) AS w FROM part GROUP BY p_size), c AS (SELECT bucket, (sum(w) OVER (ORDER BY bucket) - w)::DOUBLE / sum(w) OVER () AS lo, least(1.0, (sum(w) OVER (ORDER BY bucket))::DOUBLE / sum(w) OVER ()) AS hi FROM b)"""


def _distribution(spark, d):
    w = table(spark, d, "part").groupBy(F.col("p_size").alias("bucket")).agg(F.count("*").alias("w"))
    return stats.cdf(w, "bucket", "w")


@query(f"WITH {_CDF} SELECT bucket, round(lo, 9) AS lo, round(hi, 9) AS hi FROM c")
def cdf_build(spark, d):
    return _distribution(spark, d).select("bucket", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query(f"""WITH {_CDF}, r AS (SELECT o_orderkey AS k, ((o_orderkey * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS r FROM orders), s AS (SELECT k, min(bucket) AS bucket FROM r JOIN c ON r.r <= c.hi GROUP BY k), e AS (SELECT bucket, coalesce(lag(bucket) OVER (ORDER BY bucket), 0) AS below FROM b) SELECT k, s.bucket, below + k * 7919 % (s.bucket - below) AS size FROM s JOIN e ON s.bucket = e.bucket""")
def cdf_sample(spark, d):
    r = (F.col("k") * 1103515245 + 12345) % 2147483648 / F.lit(2147483648.0)
    w = _distribution(spark, d)
    low = w.select("bucket", (F.col("bucket") - 1).alias("low"))  # sizes of a bucket: from the one below it, if there is one, up to itself
    sizes = nearest_below(low, "low", w.select(F.col("bucket").alias("below")), "below", []).select("bucket", F.coalesce("below", F.lit(0)).alias("below"))
    drawn = stats.sampled(_orders(spark, d).select("k", r.alias("r")), "r", w.join(sizes, "bucket").withColumn("bucket", F.struct("bucket", "below")), ["bucket"])
    size = F.col("bucket.below") + F.col("k") * 7919 % (F.col("bucket.bucket") - F.col("bucket.below"))
    return drawn.select("k", F.col("bucket.bucket").alias("bucket"), size.alias("size"))


@query("""SELECT landing, background, threads, workload, count(*) AS n, grouping_id(landing, background, threads, workload) AS level
FROM (SELECT unnest([512, 1024, 2048]) AS landing), (SELECT unnest([0, 2, 4]) AS background), (SELECT unnest([1, 8, 32]) AS threads), (SELECT unnest(['read_only', 'write_only', 'read_write_8_2', 'read_write_5_5', 'scan']) AS workload)
GROUP BY ROLLUP (landing, background, threads, workload)""")
def sweep_matrix(spark, d):
    """All runs of a sweep, with totals. The axes are parameter tables of a few rows."""
    axes = {"landing int": [512, 1024, 2048], "background int": [0, 2, 4], "threads int": [1, 8, 32], "workload string": ["read_only", "write_only", "read_write_8_2", "read_write_5_5", "scan"]}
    grid = spark.range(1).drop("id")
    for schema, values in axes.items():
        grid = grid.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], schema)))
    names = [a.split()[0] for a in axes]
    return grid.rollup(*names).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# --------------------------------------------------------------------------
# Logs and JSON

_LINE = "'mixed[' || event_type || ']: ops=' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' qps=' || (event_id * 7 % 1000) END || ' stats=' || (event_id % 50) || '/' || (event_id % 50 + 9)"


@query(f"""WITH l AS (SELECT event_id AS seq, {_LINE} AS line FROM events) SELECT seq, regexp_extract(line, '\\[([^\\]]*)\\]', 1) AS codec, regexp_extract(line, 'ops=(\\S+)', 1) AS ops, CASE WHEN regexp_extract(line, 'qps=(\\S+)', 1) = '' THEN 'NA' ELSE regexp_extract(line, 'qps=(\\S+)', 1) END AS qps, regexp_extract(line, 'stats=(\\d+)/', 1)::BIGINT AS compressed, regexp_extract(line, 'stats=\\d+/(\\d+)', 1)::BIGINT AS total FROM l""")
def log_extract(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(_LINE).alias("line"))
    pair = F.split(log_field(F.col("line"), "stats"), "/")
    return lines.select("seq", F.regexp_extract("line", r"\[([^\]]*)\]", 1).alias("codec"), log_field(F.col("line"), "ops").alias("ops"), log_field(F.col("line"), "qps").alias("qps"), pair[0].cast("long").alias("compressed"), pair[1].cast("long").alias("total"))


@query("""WITH l AS (SELECT user_id AS run, event_id AS no, CASE WHEN event_type = 'error' THEN value END AS label, event_type, value FROM events), s AS (SELECT *, count(label) OVER (PARTITION BY run ORDER BY no) AS session FROM l)
SELECT run, session, count(*) FILTER (event_type = 'view') AS gets, count(*) FILTER (event_type = 'purchase') AS puts, max(label) AS label FROM s WHERE session > 0 GROUP BY run, session""")
def log_sessionize(spark, d):
    lines = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("no"), F.when(F.col("event_type") == "error", F.col("value")).alias("label"), "event_type")
    session = F.count("label").over(Window.partitionBy("run").orderBy("no"))
    own = lines.withColumn("session", session).where("session > 0")
    return own.groupBy("run", "session").agg(F.count_if(F.col("event_type") == "view").alias("gets"), F.count_if(F.col("event_type") == "purchase").alias("puts"), F.max("label").alias("label"))


@query("SELECT event_type AS op, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(DISTINCT (props->>'$.k')) AS different FROM events GROUP BY event_type")
def json_extract(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_distinct(k).alias("different"))


@query("""WITH c AS (SELECT event_id AS seq, event_id % 50 AS a, event_id % 50 + event_id % 7 - 3 AS b FROM events) SELECT seq, 'i' AS op, unnest((CASE WHEN a <= b THEN generate_series(a, b) ELSE generate_series(a, b, -1) END) || [b + 9]) AS k FROM c WHERE b >= 0""")
def udtf_expand(spark, d):
    """Keys of commands such as "i 1 4-7 9": the letter with each number, and with each of a range (backwards, if so given)."""
    commands = table(spark, d, "events").selectExpr("event_id AS seq", "event_id % 50 AS a", "event_id % 50 + event_id % 7 - 3 AS b").where("b >= 0")
    commands = commands.select("seq", F.expr("'i ' || a || '-' || b || ' ' || (b + 9)").alias("command"))
    words = F.split("command", " ")
    parts = commands.select("seq", words[0].alias("op"), F.explode(F.slice(words, 2, F.size(words))).alias("part"))
    ends = F.split("part", "-")
    a, b = ends[0].cast("long"), F.coalesce(F.get(ends, 1), ends[0]).cast("long")
    return parts.select("seq", "op", F.explode(F.sequence(a, b)).alias("k"))


# --------------------------------------------------------------------------
# Streams


@query(ORACLE_SQL["oplog_lww_state"])
def stream_lww(spark, d):
    return jobs.compacted_state(jobs.operation_stream(spark, d))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = jobs.window_counts(jobs.event_stream(spark, d))
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - i * INTERVAL 1 DAY AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2")
def stream_sliding(spark, d):
    out = jobs.window_counts(jobs.event_stream(spark, d), "2 days", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {OPS}, keys AS (SELECT ((k % 8) + 8) % 8 AS shard, k, min(seq) AS first, count(*) AS n FROM ops WHERE op IN ('put', 'delete') GROUP BY k), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY first) AS turn FROM keys)
SELECT shard, count(*) FILTER (turn <= 10) AS queued, (sum(n) FILTER (turn <= 10) - count(*) FILTER (turn <= 10))::BIGINT AS merged, coalesce(sum(n) FILTER (turn > 10), 0)::BIGINT AS dropped FROM r GROUP BY shard""")
def stream_dirty_queue(spark, d):
    return jobs.dirty_queues(jobs.operation_stream(spark, d), DEFAULT.shards, 10)


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 100")
def stream_reservoir(spark, d):
    return jobs.reservoir(jobs.event_stream(spark, d), "event_type", 100)


@query(f"""WITH {OPS}, p AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('put', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS present FROM ops)
SELECT k, count(*) FILTER (op = 'get') AS gets, count(*) FILTER (op = 'get' AND present) AS hits FROM p GROUP BY k""")
def stream_stateful(spark, d):
    return jobs.hits_by_key(jobs.operation_stream(spark, d))


# --------------------------------------------------------------------------
# Built-in shapes on the same data


@query("SELECT event_type AS op, user_id % 4 AS shard, count(*) AS n, round(sum(value), 4) AS total, grouping_id(event_type, user_id % 4) AS level FROM events GROUP BY ROLLUP (event_type, user_id % 4)")
def rollup_ops(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 4).alias("shard"), "value")
    return e.rollup("op", "shard").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("level"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def setops_tiers(spark, d):
    o = table(spark, d, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 3 = 0").select("o_custkey")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first")).unionByName(count(a.union(b).distinct(), "any"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, g""")
def session_windows(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_batch(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT event_id, user_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_type, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS last_value FROM events")
def lead_next_event(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lead("event_type").over(w).alias("next_type"), F.lag("value").over(w).alias("last_value"))


@query(f"""WITH {OPS}, {LWW} SELECT {_tier_sql('(abs(k) * 61 % 4000)')} AS tier, count(*) AS keys, sum(abs(k) * 61 % 4000)::BIGINT AS bytes, round(sum(v), 4) AS total FROM lww GROUP BY 1""")
def flagship_tiered_state(spark, d):
    """Operation log to live keys to tiers: what the cache holds, by tier."""
    live = oplog.last_wins(_ops(spark, d)).withColumn("size", F.abs("k") * 61 % 4000)
    return live.groupBy(S.tier_of(F.col("size")).alias("tier")).agg(F.count("*").alias("keys"), F.sum("size").alias("bytes"), F.round(F.sum("v"), 4).alias("total"))


from . import queries_files, queries_store  # noqa: E402, F401  registers theirs too
