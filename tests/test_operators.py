"""Hand-checked cases and properties of the library's operators."""

import datetime
import os
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierlake.config import Config
from tierlake.functions import scalars as S
from tierlake.operators import codec, evict, lookup, objects, oplog, stats
from tierlake.plans.prefix import nearest_below, running
from tierlake.sources import tables
from tierlake.streaming import jobs


def test_ranges_take_the_greatest_key(spark):
    state = spark.createDataFrame([(1, 101.0), (5, 105.0), (9, 109.0), (13, 113.0), (21, 221.0)], "k long, v double")
    ranges = spark.createDataFrame([(0, 1, 21), (1, 13, 1), (2, 22, 30)], "id long, lo long, hi long")
    assert {r.id: r.v for r in lookup.last_in(ranges, state).collect()} == {0: 221.0, 1: 113.0, 2: None}
    assert {r.id: r.n for r in lookup.counts_in(ranges, state, "n").collect()} == {0: 5, 1: 0, 2: 0}
    assert [r.id for r in lookup.ranges_with(ranges, state).collect()] == [0]


def test_log_folds_like_a_dict(spark):
    rng = random.Random(1337)
    log = [(i, rng.randrange(40), float(rng.randrange(1, 100)), rng.choice(["put", "put", "delete", "get"])) for i in range(1500)]
    last, first, reads = {}, {}, {}
    for seq, k, v, op in log:
        if op == "put":
            last[k] = v
            first.setdefault(k, v)
        elif op == "delete":
            last.pop(k, None)
        else:
            reads[seq] = last.get(k)
    ops = spark.createDataFrame(log, "seq long, k long, v double, op string")
    assert {r.k: r.v for r in oplog.last_wins(ops).collect()} == last
    assert {r.k: r.v for r in oplog.first_wins(ops).collect()} == first
    assert {r.seq: r.v for r in oplog.reads_along(ops).collect()} == reads


def test_places_are_aligned(spark):
    rows = objects.appended(spark.createDataFrame([(1, 1), (2, 4096), (3, 4097), (4, 5)], "seq long, size long"), 4096).orderBy("seq").collect()
    assert [r.lba for r in rows] == [0, 4096, 8192, 16384]


def test_running_sums_over_slices(spark):
    values = [(i, (i * 37) % 11) for i in range(500)]
    got = {r.k: r.before for r in running(spark.createDataFrame(values, "k long, v long"), "k", F.col("v"), "before").collect()}
    total = 0
    for k, v in values:
        assert got[k] == total
        total += v


def test_thresholds():
    with pytest.raises(ValueError):
        Config(tiny=10, medium=10)
    with pytest.raises(ValueError):
        Config(shards=0)
    assert Config().with_thresholds(64, 512).medium == 512


def test_tier_borders(spark):
    sizes = spark.createDataFrame([(128,), (129,), (2048,), (2049,), (None,)], "s long").select(S.tier_of(F.col("s")).alias("t"))
    assert [r.t for r in sizes.collect()] == ["TINY", "MEDIUM", "MEDIUM", "LARGE", "UNKNOWN"]


def test_key_hash(spark):
    words = spark.createDataFrame([("click",), ("error",), ("view",), ("",)], "w string").select(S.fnv1a32(F.col("w")).alias("h"))
    assert [r.h for r in words.collect()] == [1551804527, 563185489, 3685020920, 2166136261]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40)], "op string, v double")
    row = stats.latency_summary(df, ["op"], "v").head()
    assert (row.p50, row.p90, row.n) == (25.0, 37.0, 4)
    assert stats.nearest_rank(df, "op", "v").head().p == 40.0


def test_clock_gives_a_second_chance(spark):
    pages = spark.createDataFrame([(0, i, i in (0, 2)) for i in range(4)], "shard long, page long, accessed boolean")
    assert [(r.page, r.turn) for r in evict.second_chance(pages, 3 * 4096).orderBy("turn").collect()] == [(1, 0), (3, 1), (0, 2)]


@given(st.lists(st.binary(max_size=300), max_size=5))
def test_checksums(values):
    data, n = np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)
    want = []
    for raw in values:
        a = b = c = 0
        d = 5381
        for x in raw:
            a = (a << 1 & S.U32) ^ x
            a ^= a >> 16
            b = ((b << 1 | b >> 31) & S.U32) ^ x
            c = (c * 31 + x) & 0x7FFFFFFF
            d = (d * 33 + x) & S.U32
        want.append((a, b, c or 1, abs(d - (1 << 32) if d >> 31 else d) + 1))
    assert [*zip(*(f(data, n).tolist() for f in (S.fold_shift, S.fold_rotate, S.fold_31, S.fold_33)), strict=True)] == want


def _taken(f, *args) -> int:
    """The most bytes that f takes beside its arguments."""
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


#: 32 MB in one value, and in values of 4 KB.
_LARGE = np.zeros(32 << 20, np.uint8), (np.array([32 << 20]), np.full(8 << 10, 4 << 10))


def test_shift_takes_a_block_at_a_time():
    for n in _LARGE[1]:
        assert _taken(S.fold_shift, _LARGE[0], n) < len(_LARGE[0])


def test_polynomials_take_a_block_at_a_time():
    for n in _LARGE[1]:
        assert max(_taken(f, _LARGE[0], n) for f in (S.fold_33, S.fold_31)) < len(_LARGE[0])


def test_rotation_takes_a_block_at_a_time():
    for n in _LARGE[1]:
        assert _taken(S.fold_rotate, _LARGE[0], n) < len(_LARGE[0])


def test_compressed_sizes_keep_no_values():
    values = pa.array([os.urandom(1 << 20)] * 32 + [None, b""], pa.binary())
    assert _taken(codec.compressed_sizes, values, 1) < 8 << 20
    assert codec.compressed_sizes(values[31:], 6).to_pylist() == [len(zlib.compress(values[31].as_py(), 6)), None, 8]


def test_codec_nulls(spark):
    values = spark.createDataFrame([(b"a" * 3_000_000,), (b"",), (None,)], "v binary")
    packed = codec.compressor(6)(F.col("v"))
    got = values.select((codec.decompress(packed) == F.col("v")).alias("same"), (codec.size_after(6)(F.col("v")) == F.octet_length(packed)).alias("size")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (None, None)]


def test_batches_are_folded_where_they_lie():
    values = pa.array([b"\0" * (4 << 10)] * (8 << 10), pa.binary())
    assert _taken(S.folded, S.fold_shift, values) < values.nbytes


def _taken_of_a_batch(fold) -> float:
    """The most that a fold takes of a batch of 60 KB values, Arrow's memory included, as a share of the batch."""
    values, pool, usual = pa.array([b"\1" * 60_000] * 560, pa.binary()), pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        return (_taken(S.folded, fold, values) + pool.max_memory()) / values.nbytes
    finally:
        pa.set_memory_pool(usual)


def test_shift_of_a_batch_of_long_values():
    assert _taken_of_a_batch(S.fold_shift) < 1


def test_hashes_of_a_batch_of_long_values():
    assert max(map(_taken_of_a_batch, (S.fold_31, S.fold_33))) < 1


def _long_values():
    rng = random.Random(5)
    return pa.array([rng.randbytes(3 * S.BLOCK_BYTES + 5), None, b"", rng.randbytes(S.BLOCK_BYTES), rng.randbytes(S.BLOCK_BYTES + 1), b"x"], pa.binary())


def test_shift_of_values_longer_than_a_block():
    values = _long_values()
    want = []
    for raw in values.to_pylist():
        c = 0
        for b in raw or b"":
            c = (c << 1 & S.U32) ^ b
            c ^= c >> 16
        want.append(None if raw is None else c)
    assert S.folded(S.fold_shift, values).to_pylist() == want


def test_hashes_of_values_longer_than_a_block():
    values = _long_values()
    for fold, base, start, finish in ((S.fold_31, 31, 0, lambda h: h & 0x7FFFFFFF or 1), (S.fold_33, 33, 5381, lambda h: min(h, (1 << 32) - h) + 1)):
        want = []
        for raw in values.to_pylist():
            h = start
            for b in raw or b"":
                h = (h * base + b) & S.U32
            want.append(None if raw is None else finish(h))
        assert S.folded(fold, values).to_pylist() == want


def test_reads_check_the_last_byte_of_long_bodies(spark):
    body = "é0123456789" * 60_000
    rows = [(0, body, body), (1, body, body[:-1]), (2, body, body[:-1] + "0"), (3, body, "0" + body[:-1]), (4, body, None)]
    written = spark.createDataFrame(rows, "seq long, body string, there string").withColumns({"lba": F.col("seq") * 4096, "size": F.octet_length("body").cast("long"), "checksum": S.checksum_shift(F.col("body"))})
    read = objects.read_checked(written.select("seq", "lba", "size", "checksum"), written.select("lba", F.col("there").alias("body")), S.checksum_shift)
    assert {r.seq: r.status for r in read.collect()} == {0: "OK"} | dict.fromkeys((1, 2, 3, 4), "IO_ERROR")


@given(st.lists(st.binary(max_size=60), max_size=8), st.integers(1, 20))
def test_checksums_of_small_blocks(values, size):
    data, n = np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)
    with pytest.MonkeyPatch.context() as patch:
        want = [f(data, n).tolist() for f in (S.fold_shift, S.fold_rotate, S.fold_31, S.fold_33)]
        patch.setattr(S, "BLOCK_BYTES", size)
        assert [f(data, n).tolist() for f in (S.fold_shift, S.fold_rotate, S.fold_31, S.fold_33)] == want


def test_raw_bytes_of_a_part():
    values = pa.array([b"xx", None, b"", b"abc", None, b"d", b"yy"], pa.binary())
    data, n = S.raw_bytes(values[1:6])
    assert (data.tobytes(), n.tolist()) == (b"abcd", [0, 0, 3, 0, 1])


def test_hash_of_a_known_text(spark):
    assert spark.createDataFrame([("a",), ("",), (None,)], "t string").select(S.hash33(F.col("t")).alias("h")).collect() == [(177671,), (5382,), (None,)]


def test_key_hash_signs_bytes(spark):
    def want(raw):
        h = 2166136261
        for b in raw:
            h = ((h ^ (b | 0xFFFFFF00 if b >= 128 else b)) * 16777619) & S.U32
        return h

    words = ["é", "naïve", "x" * 300, "日本"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(S.fnv1a32(F.col("w")).alias("h")).collect()
    assert [r.h for r in got] == [want(w.encode()) for w in words]


def test_slices_of_many_partitions(spark):
    """Orders over the whole table hold at thousands of shuffle partitions."""
    from tierlake.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    some = "/root/testdata/sf0.001"
    try:
        plain = {n: sorted(map(str, QUERIES[n](spark, some).collect())) for n in ("leaf_pack", "lba_allocate", "landing_epochs")}
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        assert {n: sorted(map(str, QUERIES[n](spark, some).collect())) for n in plain} == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True), st.lists(st.integers(-5, 70), min_size=1, max_size=12))
@settings(max_examples=5, deadline=None)
def test_nearest_keys(spark, keys, probes):
    state = spark.createDataFrame([(k, k * 2) for k in keys], "k long, v long")
    got = nearest_below(spark.createDataFrame([(p, i) for i, p in enumerate(probes)], "p long, i long"), "p", state, "k", ["v"])
    assert sorted((r.i, r.k) for r in got.collect() if r.k is not None) == [(i, max(k for k in keys if k <= p)) for i, p in enumerate(probes) if min(keys) <= p]
    assert got.count() == len(probes)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """A stream that is stopped after some files and started again with more ends where one that read all at once does."""
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(12), rng.choice(["view", "purchase", "error", "click"]), float(i), start + datetime.timedelta(hours=i)) for i in range(240)]
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"

    def run(name, sizes):
        folder = tmp_path / name
        folder.mkdir()
        at = 0
        for i, n in enumerate(sizes):
            spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.parquet(f"file://{folder}/in/{i}")
            at += n
            events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
            ops = tables.operations(events)
            out = [jobs.compacted_state(ops, f"file://{folder}/a"), jobs.hits_by_key(ops, f"file://{folder}/b"), jobs.dirty_queues(ops, 2, 3, f"file://{folder}/c"), jobs.window_counts(events, "2 days", "1 day", base=f"file://{folder}/d"), jobs.reservoir(events, "event_type", 7, f"file://{folder}/e")]
        return [sorted(map(str, df.collect())) for df in out]

    assert run("parts", [100, 50, 90]) == run("whole", [240])


def test_late_events_are_left_out(spark, tmp_path):
    schema = "event_id long, event_type string, ts timestamp"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for i, days in enumerate([[0, 0, 1], [10], [0, 9, 10], [11]]):
        spark.createDataFrame([(n, "view", day(n)) for n in days], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        got = jobs.window_counts(events, base=f"file://{tmp_path}/job").collect()
    assert sorted((r.start, r.n) for r in got) == [(day(0), 2), (day(1), 1), (day(9), 1), (day(10), 2), (day(11), 1)]


def test_operation_files(spark, tmp_path):
    ops = [(i, "irs"[i % 3], i * 7 % 50, i * 7 % 50 + 3 if i % 3 == 1 else None) for i in range(500)]
    path = f"file://{tmp_path}/ops"
    tables.write_op_file(spark.createDataFrame(ops, "seq long, op string, a long, b long").repartition(7), path)
    assert sorted(tuple(r) for r in tables.read_op_file(spark, path).collect()) == ops


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("lz4", "get", 0, "1.5"), ("lz4", "put", 1, "x")], "algorithm string, op string, index long, latency_ns string")
    tables.write_latency_csv(df, str(tmp_path / "csv"))
    assert sorted((r.op, r.latency_ns) for r in tables.read_latency_csv(spark, str(tmp_path / "csv")).collect()) == [("get", 1.5), ("put", None)]
    tables.write_tsv(df, str(tmp_path / "tsv"))
    assert tables.read_tsv(spark, str(tmp_path / "tsv")).count() == 2
    lines = spark.createDataFrame([(0, "wall_sec=1"), (1, "wall_sec=2"), (2, "none")], "no long, value string")
    assert [tuple(r) for r in tables.key_values(lines).collect()] == [("wall_sec", "1")]


def test_imports_without_the_training_data_subpackage():
    code = "import sys; sys.modules['tierlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'oplog_lww_state' in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
