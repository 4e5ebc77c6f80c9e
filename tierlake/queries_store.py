"""Queries over tiers, object pointers, hashed pages and leaves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import scalars as S
from .operators import lookup, objects, oplog, pages
from .plans.prefix import numbered, running
from .queries import _SIZES, LWW, OPS, _fold, _objects, _ops, _orders
from .registry import query
from .sources.tables import settle, table


# --------------------------------------------------------------------------
# Deletes over tiers


@query(f"""WITH {OPS}, {LWW}, lo AS (SELECT DISTINCT k FROM lww WHERE k % 3 = 0), dram AS (SELECT DISTINCT k FROM lww WHERE k % 3 <> 0), gone AS (SELECT DISTINCT user_id + 2 AS k FROM events WHERE event_type = 'error')
SELECT k, k IN (SELECT k FROM dram) AS in_dram, k IN (SELECT k FROM lo) AS in_lo, CASE WHEN k IN (SELECT k FROM dram) OR k IN (SELECT k FROM lo) THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM gone""")
def cache_delete(spark, d):
    """Deletes over the tiers of memory and of large objects; page writes of zero never succeed, so pages decide nothing."""
    ops = _ops(spark, d)
    live = oplog.last_wins(ops).select("k", F.when(F.col("k") % 3 == 0, "lo").otherwise("dram").alias("tier"))
    gone = ops.where("op = 'delete'").select((F.col("k") + 2).alias("k")).distinct()
    met = gone.join(live, "k", "left").groupBy("k").agg(*[F.coalesce(F.bool_or(F.col("tier") == t), F.lit(False)).alias(f"in_{t}") for t in ("dram", "lo")])
    return met.withColumn("status", F.when(F.col("in_dram") | F.col("in_lo"), "OK").otherwise("NOT_FOUND"))


@query(f"WITH {OPS}, {LWW}, gone AS (SELECT DISTINCT user_id + 2 AS k FROM events WHERE event_type = 'error') SELECT k, v FROM lww WHERE k NOT IN (SELECT k FROM gone)")
def cache_after_delete(spark, d):
    ops = _ops(spark, d)
    return oplog.last_wins(ops).join(ops.where("op = 'delete'").select((F.col("k") + 2).alias("k")), "k", "left_anti").select("k", "v")


# --------------------------------------------------------------------------
# Object pointers

_POINTERS = f"""{OPS}, po AS (SELECT seq, k, op, CASE WHEN k % 10 = 0 THEN 0 ELSE seq * 4096 END AS lba, CASE WHEN k % 10 = 0 THEN 0 ELSE (k * 37 % 2000 + 1) END AS size, seq % 1000 AS checksum FROM ops WHERE op IN ('put', 'delete')),
pl AS (SELECT k, lba, size, checksum FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM po WHERE op = 'delete' OR lba <> 0 OR size <> 0) WHERE r = 1 AND op <> 'delete')"""


def _pointers(spark, d):
    none = F.col("k") % 10 == 0
    p = objects.pointer(F.when(none, 0).otherwise(F.col("seq") * 4096), F.when(none, 0).otherwise(F.col("k") * 37 % 2000 + 1), F.col("seq") % 1000)
    return oplog.writes(_ops(spark, d)).select("seq", "k", "op", p.alias("p"))


def _pointer_state(spark, d):
    took = _pointers(spark, d).where((F.col("op") == "delete") | S.pointer_is_valid(F.col("p.lba"), F.col("p.size")))
    return oplog.last_wins(took.withColumnRenamed("p", "v")).select("k", F.col("v").alias("p"))


@query(f"WITH {_POINTERS} SELECT k, lba::BIGINT AS lba, size::BIGINT AS size, checksum::BIGINT AS checksum FROM pl")
def lo_pointer_state(spark, d):
    """Last valid pointer of each key; an invalid one changes nothing."""
    return _pointer_state(spark, d).select("k", "p.*")


@query(f"""WITH {_POINTERS}, s AS (SELECT *, coalesce(last_value(CASE WHEN op = 'delete' OR lba <> 0 OR size <> 0 THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS present FROM po)
SELECT seq, k, op, CASE WHEN CASE WHEN op = 'put' THEN lba <> 0 OR size <> 0 ELSE present END THEN 0 ELSE -1 END AS status FROM s""")
def lo_op_status(spark, d):
    return objects.pointer_status(_pointers(spark, d))


@query(f"WITH {_POINTERS}, pr AS (SELECT DISTINCT user_id AS k FROM events UNION SELECT DISTINCT user_id + 7 FROM events) SELECT pr.k, coalesce(lba, 0)::BIGINT AS lba, coalesce(size, 0)::BIGINT AS size, coalesce(checksum, 0)::BIGINT AS checksum FROM pr LEFT JOIN pl ON pr.k = pl.k")
def lo_get(spark, d):
    probes = _ops(spark, d).select(F.explode(F.array("k", F.col("k") + 7)).alias("k")).distinct()
    return objects.pointers(probes, _pointer_state(spark, d))


@query(f"WITH {_POINTERS}, a AS (SELECT k, lba, size, checksum, CASE WHEN k % 4 = 0 THEN lba + 1 ELSE lba END AS lba2, CASE WHEN k % 6 = 0 THEN size + 1 ELSE size END AS size2 FROM pl) SELECT k, lba = lba2 AND size = size2 AS same FROM a")
def pointer_equal(spark, d):
    """Pointers against copies with another checksum, and some with another place or size."""
    p = _pointer_state(spark, d)
    moved = objects.pointer(F.col("p.lba") + F.when(F.col("k") % 4 == 0, 1).otherwise(0), F.col("p.size") + F.when(F.col("k") % 6 == 0, 1).otherwise(0), F.col("p.checksum") + 1)
    return p.select("k", S.pointers_equal(F.col("p"), moved).alias("same"))


_SHIFT = _fold(0, "xor(xor((c << 1) & 4294967295, b), xor((c << 1) & 4294967295, b) >> 16)").replace("FROM documents", "FROM big")
_STORED = f"""WITH b AS (SELECT doc_id, text, octet_length(encode(text))::BIGINT AS size FROM documents WHERE octet_length(encode(text)) > 2048),
big AS (SELECT * FROM b), written AS (SELECT doc_id, (sum((size + 4095) // 4096 * 4096) OVER (ORDER BY doc_id) - (size + 4095) // 4096 * 4096)::BIGINT AS lba, size FROM b), sums AS ({_SHIFT})"""


def _written(spark, d):
    """All documents of a large object's size, appended to storage: place, size, body, checksum."""
    docs = _objects(spark, d).where(F.col("size") > DEFAULT.medium)
    placed = objects.appended(docs.select("seq", "size", F.col("text").alias("body")), DEFAULT.alignment)
    return placed.withColumn("checksum", S.checksum_shift(F.col("body")))


@query(f"{_STORED} SELECT w.doc_id AS seq, w.lba, w.size, s.checksum FROM written w JOIN sums s ON w.doc_id = s.doc_id")
def object_write(spark, d):
    return _written(spark, d).select("seq", "lba", "size", "checksum")


@query(f"""{_STORED}, broken AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN left(text, length(text) - 1) WHEN 1 THEN reverse(text) ELSE text END AS text FROM b), sums2 AS ({_SHIFT.replace("FROM big", "FROM broken")})
SELECT w.doc_id AS seq, CASE WHEN w.doc_id % 7 <> 3 AND w.doc_id % 5 <> 0 AND s.checksum = t.checksum THEN 'OK' ELSE 'IO_ERROR' END AS status FROM written w JOIN sums s ON w.doc_id = s.doc_id JOIN sums2 t ON w.doc_id = t.doc_id""")
def object_read(spark, d):
    """Descriptors joined to storage by place; some bodies there are cut, changed or missing."""
    written = settle(_written(spark, d))
    body = F.when(F.col("seq") % 5 == 0, F.expr("left(body, length(body) - 1)")).when(F.col("seq") % 5 == 1, F.reverse("body")).otherwise(F.col("body"))
    storage = written.where("seq % 7 != 3").select("lba", body.alias("body"))
    return objects.read_checked(written.select("seq", "lba", "size", "checksum"), storage, S.checksum_shift).select("seq", "status")


@query("SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN false ELSE event_id % 4 <> 0 END AS good FROM events")
def pointer_verify(spark, d):
    """Invalid pointers and missing bodies never verify; others by their rotated checksum."""
    e = table(spark, d, "events").select("event_id", "props", F.octet_length("props").cast("long").alias("size"), S.checksum_rotate(F.col("props")).alias("found"))
    known = e.withColumn("checksum", F.col("found") + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0))
    gone = F.col("event_id") % 6 == 0
    valid = S.pointer_is_valid(F.when(gone, 0).otherwise(F.col("event_id")), F.when(gone, 0).otherwise(F.col("size")))
    return known.select(F.col("event_id").alias("seq"), (valid & F.coalesce(F.col("found") == F.col("checksum"), F.lit(False))).alias("good"))


# --------------------------------------------------------------------------
# Hashed pages

_KNUTH = "(xor(xor(h, h >> 16), xor(h, h >> 16) >> 8)) % 16"
_SSD = f"""{OPS}, hp AS (SELECT seq, k, CASE WHEN op = 'delete' THEN 0 ELSE v END AS v, ((k & 4294967295)::HUGEINT * 2654435761 % 4294967296)::BIGINT AS h FROM ops WHERE op IN ('put', 'delete')), ssd AS (SELECT {_KNUTH} AS bucket, k, arg_max(v, seq) AS v FROM hp WHERE v <> 0 GROUP BY 1, 2)"""


def _page_puts(spark, d):
    puts = oplog.writes(_ops(spark, d))
    return puts.select("seq", S.knuth_bucket(F.col("k"), DEFAULT.buckets).alias("bucket"), "k", F.when(F.col("op") == "delete", 0.0).otherwise(F.col("v")).alias("v"))


@query(f"WITH {_SSD} SELECT seq, {_KNUTH} AS bucket, CASE WHEN v = 0 THEN -1 ELSE 0 END AS status FROM hp")
def ssd_put_status(spark, d):
    return _page_puts(spark, d).select("seq", "bucket", F.when(F.col("v") == 0, -1).otherwise(0).alias("status"))


@query(f"WITH {_SSD} SELECT bucket, k, v FROM ssd")
def ssd_state(spark, d):
    """Last value of each key in its page; writes of zero are refused and change nothing."""
    return _page_puts(spark, d).where("v != 0").groupBy("bucket", "k").agg(F.max_by("v", "seq").alias("v"))


@query(f"WITH {_SSD}, pr AS (SELECT k, {_KNUTH} AS bucket FROM (SELECT k, ((k & 4294967295)::HUGEINT * 2654435761 % 4294967296)::BIGINT AS h FROM (SELECT DISTINCT user_id + 3 AS k FROM events))) SELECT pr.k, pr.bucket, coalesce(ssd.v, -1.0) AS v FROM pr LEFT JOIN ssd ON pr.k = ssd.k AND pr.bucket = ssd.bucket")
def ssd_get(spark, d):
    probes = _ops(spark, d).select((F.col("k") + 3).alias("k")).distinct().withColumn("bucket", S.knuth_bucket(F.col("k"), DEFAULT.buckets))
    state = _page_puts(spark, d).where("v != 0").groupBy("bucket", "k").agg(F.max_by("v", "seq").alias("v"))
    return probes.join(state, ["bucket", "k"], "left").select("k", "bucket", F.coalesce("v", F.lit(-1.0)).alias("v"))


# --------------------------------------------------------------------------
# Values of any length, and string keys


@query(f"""WITH {_SIZES}, r AS (SELECT *, row_number() OVER (PARTITION BY size <= 128, size > 2048 ORDER BY seq) - 1 AS n, (sum(size) OVER (PARTITION BY size <= 128, size > 2048 ORDER BY seq) - size)::BIGINT AS place FROM objects WHERE size IS NOT NULL)
SELECT seq, CASE WHEN size <= 128 THEN text WHEN size <= 2048 THEN n::VARCHAR ELSE place::VARCHAR || '-' || size::VARCHAR END AS stored FROM r""")
def varlen_insert(spark, d):
    """What a leaf stores: a tiny value itself, a medium one's number in the side vector, a large one's "offset-length" in the file."""
    own = _objects(spark, d).where("size IS NOT NULL").withColumn("tier", S.tier_of(F.col("size")))
    tiny = own.where("tier = 'TINY'").select("seq", F.col("text").alias("stored"))
    medium = numbered(own.where("tier = 'MEDIUM'").select("seq"), "seq", "n").select("seq", F.col("n").cast("string").alias("stored"))
    large = running(own.where("tier = 'LARGE'").select("seq", "size"), "seq", F.col("size"), "at")
    return tiny.unionByName(medium).unionByName(large.select("seq", F.concat_ws("-", F.col("at").cast("string"), F.col("size").cast("string")).alias("stored")))


@query("SELECT p.name, c.c_custkey IS NOT NULL AS found, c.c_custkey AS k FROM (SELECT c_name || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END AS name FROM customer WHERE c_custkey % 2 = 0) p LEFT JOIN customer c ON c.c_name = p.name")
def string_key_search(spark, d):
    customers = table(spark, d, "customer")
    probes = customers.where("c_custkey % 2 = 0").select(F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise("")).alias("name"))
    return probes.join(customers.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")), "name", "left").select("name", F.col("k").isNotNull().alias("found"), "k")


# --------------------------------------------------------------------------
# Leaves

_LEAVES = "n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 30 AS leaf FROM orders)"
_RANKED = f"{_LEAVES}, r AS (SELECT leaf, k, row_number() OVER (PARTITION BY leaf ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY leaf) AS n FROM n)"


def _leaves(spark, d):
    return pages.packed(_orders(spark, d), DEFAULT.leaf_slots)


@query(f"WITH {_LEAVES}, s AS (SELECT leaf, min(k) AS least FROM n GROUP BY leaf), p AS (SELECT DISTINCT l_orderkey + 1 AS k FROM lineitem) SELECT p.k, coalesce(s.leaf, 0) AS leaf FROM p ASOF LEFT JOIN s ON p.k >= s.least")
def leaf_route(spark, d):
    """Keys to leaves by separators: smaller than a separator means to its left."""
    probes = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1).alias("k")).distinct()
    return lookup.routed(probes, pages.separators(_leaves(spark, d)).select("least", "leaf"))


@query(f"WITH {_RANKED} SELECT leaf, CASE WHEN r < 3 THEN -1 ELSE k % 16 END AS bucket, count(*) AS n, min(k) AS least FROM r GROUP BY 1, 2")
def leaf_rebuild(spark, d):
    """A leaf's first keys stay in its landing buffer (bucket -1), the others go to buckets."""
    own = pages.ranked(_leaves(spark, d), "leaf")
    bucket = F.when(F.col("r") < DEFAULT.landing_slots, -1).otherwise(F.pmod("k", F.lit(DEFAULT.buckets)))
    return own.groupBy("leaf", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("least"))


@query(f"""WITH {_LEAVES}, b AS (SELECT leaf, k % 16 AS bucket, count(*) AS n, count(*) FILTER (k % 7 = 0) AS landing FROM n GROUP BY 1, 2)
SELECT leaf, sum(landing)::BIGINT AS landing, CASE WHEN sum(landing) = 0 THEN 0 WHEN max(n) > 3 THEN -1 ELSE 1 END AS status FROM b GROUP BY leaf""")
def landing_flush(spark, d):
    """1: compacted, 0: nothing in the landing buffer, -1: a bucket overflows."""
    own = _leaves(spark, d).groupBy("leaf", F.pmod("k", F.lit(DEFAULT.buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("k") % 7 == 0).alias("landing"))
    status = F.when(F.sum("landing") == 0, 0).when(F.max("n") > 3, -1).otherwise(1)
    return own.groupBy("leaf").agg(F.sum("landing").alias("landing"), status.alias("status"))


@query(f"WITH {_RANKED}, m AS (SELECT *, min(k) FILTER (r = n // 2) OVER (PARTITION BY leaf) AS median FROM r) SELECT leaf, k >= median AS upper, k % 16 AS bucket, count(*) AS n, min(median) AS median FROM m GROUP BY 1, 2, 3")
def super_leaf_split(spark, d):
    """Both halves of a split, dealt anew to their pages; keys below the median go left."""
    own = pages.ranked(_leaves(spark, d), "leaf")
    median = F.min(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("k"))).over(Window.partitionBy("leaf"))  # a leaf's slots at most
    split = own.withColumn("median", median)
    return split.groupBy("leaf", (F.col("k") >= F.col("median")).alias("upper"), F.pmod("k", F.lit(DEFAULT.buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.min("median").alias("median"))


@query(f"WITH {_RANKED} SELECT leaf, min(k) FILTER (r = greatest(n // 2 - 1, 0)) AS split_key, count(*) FILTER (r <= greatest(n // 2 - 1, 0)) AS n_left, count(*) FILTER (r > greatest(n // 2 - 1, 0)) AS n_right FROM r GROUP BY leaf")
def hash_split(spark, d):
    """The older split: the last key of the lower half stays left with all up to it."""
    at = F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(0))
    own = pages.ranked(_leaves(spark, d), "leaf")
    return own.groupBy("leaf").agg(F.min(F.when(F.col("r") == at, F.col("k"))).alias("split_key"), F.count_if(F.col("r") <= at).alias("n_left"), F.count_if(F.col("r") > at).alias("n_right"))


@query(f"WITH {_LEAVES}, l AS (SELECT leaf, count(*) AS n FROM n GROUP BY leaf) SELECT count(*) AS leaves, ceil(count(*) / 64)::BIGINT AS inner_nodes, sum(n)::BIGINT AS keys, round(sum(n) / count(*), 6) AS keys_per_leaf, (count(*) * 4096 + ceil(count(*) / 64) * 4096)::BIGINT AS bytes FROM l")
def node_counts(spark, d):
    l = pages.separators(_leaves(spark, d)).agg(F.count("*").alias("leaves"), F.sum("n").alias("keys"))
    inner = F.ceil(F.col("leaves") / 64)
    return l.select("leaves", inner.alias("inner_nodes"), "keys", F.round(F.try_divide("keys", "leaves"), 6).alias("keys_per_leaf"), ((F.col("leaves") + inner) * 4096).alias("bytes"))


@query(f"""WITH {_LEAVES}, s AS (SELECT leaf, min(k) AS least FROM n GROUP BY leaf)
SELECT 1 AS level, leaf AS node, string_agg(k::VARCHAR, ' ' ORDER BY k) AS keys FROM n GROUP BY leaf UNION ALL SELECT 0, leaf // 64, string_agg(least::VARCHAR, ' ' ORDER BY leaf) FROM s GROUP BY leaf // 64""")
def tree_dump(spark, d):
    """Each node with its level and keys, in order: inner nodes show their children's least keys."""
    own = settle(_leaves(spark, d))
    line = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), " ")  # noqa: E731  a node's keys
    leaves = own.groupBy(F.col("leaf").alias("node")).agg(line("k").alias("keys"))
    inner = own.groupBy("leaf").agg(F.min("k").alias("least")).groupBy(F.floor(F.col("leaf") / 64).alias("node")).agg(line("least").alias("keys"))
    return inner.select(F.lit(0).alias("level"), "node", "keys").unionByName(leaves.select(F.lit(1).alias("level"), "node", "keys")).orderBy("level", "node")


@query(f"WITH {OPS}, {LWW} SELECT k % 8 AS shard, count(*) AS size, count(*) = 0 AS empty FROM lww GROUP BY 1")
def state_size(spark, d):
    return oplog.last_wins(_ops(spark, d)).groupBy(S.shard_of(F.col("k"), DEFAULT.shards).alias("shard")).agg(F.count("*").alias("size"), (F.count("*") == 0).alias("empty"))


# --------------------------------------------------------------------------
# Payloads of keys and versions

_CHUNKS = "raw AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE octet_length(encode(text)) >= 128), parts AS (SELECT doc_id, i, substr(x, i * 256 + 1, 256) AS body FROM (SELECT doc_id, x, unnest(generate_series(0, length(x) // 256 - 1)) AS i FROM raw)), chunks AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS id, body FROM parts), total AS (SELECT count(*) AS n FROM chunks)"


def _chunks(spark, d):
    from .queries import slice_chunks

    return settle(numbered(slice_chunks(spark, d), ["doc_id", "chunk"], "id").select("id", "body"))


def _payloads(spark, d, chunks):
    n = chunks.agg(F.count("*").alias("total"))
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), (F.col("event_id") % 7).alias("version")).crossJoin(F.broadcast(n))  # one row
    return e.withColumn("id", F.pmod(F.col("k") - 1 + F.col("version"), F.col("total"))).join(chunks, "id")


@query(f"WITH {_CHUNKS} SELECT event_id AS seq, user_id AS k, md5(body) AS payload FROM events, total JOIN chunks ON id = ((user_id - 1 + event_id % 7) % n + n) % n")
def payload_of_version(spark, d):
    """The slice that is the payload of a key's version."""
    return _payloads(spark, d, _chunks(spark, d)).select("seq", "k", F.md5("body").alias("payload"))


@query(f"WITH {_CHUNKS} SELECT user_id % 8 AS shard, count(*) AS payloads, count(*) FILTER (event_id % 11 = 0) AS wrong FROM events GROUP BY 1")
def payload_scan(spark, d):
    """A full scan that compares every stored payload with its key's and version's slice; every eleventh was changed."""
    chunks = _chunks(spark, d)
    own = _payloads(spark, d, chunks).select("k", "version", "total", F.when(F.col("seq") % 11 == 0, F.reverse(F.concat("body", F.lit("x")))).otherwise(F.col("body")).alias("stored"))
    met = own.withColumn("id", F.pmod(F.col("k") - 1 + F.col("version"), F.col("total"))).join(chunks, "id")
    return met.groupBy((F.col("k") % 8).alias("shard")).agg(F.count("*").alias("payloads"), F.count_if(F.col("stored") != F.col("body")).alias("wrong"))


