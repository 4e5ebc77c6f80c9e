"""Each query against its SQL on DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tierlake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    return f"{float(v):.9g}" if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    out = duck.sql(ORACLE_SQL[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


#: Null and empty texts, zero bytes, and texts at and above a block's length.
ODD_TEXTS = [None, "", "\0", "a\0b", "é😀", None, "x" * (256 << 10), "é" * (128 << 10) + "a", ""]


@pytest.mark.parametrize("name", ["checksum_shift", "checksum_rotl", "hash31", "hash33"])
def test_checksums_of_odd_texts(name, spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(ODD_TEXTS)), pa.int64()), "text": pa.array(ODD_TEXTS, pa.string())}), tmp_path / "documents.parquet")
    want = duckdb.connect().execute(ORACLE_SQL[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).fetchall()
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def _large_texts(folder):
    """Documents around a large object's least size, around 6,000 bytes and above a checksum's block; some spell the same both ways."""
    texts = [None, "", "a" * 128, "a" * 2048, "a" * 2049, "é" * 1024 + "a", "ab" * 3000, "ab" * 3000 + "c", "a" * 6001, "é" * 3001, None, "ab" * 9000, "x" * 70_000, "é0" * 100_000]
    texts = {i * 11 + shift: t for i, t in enumerate(texts) for shift in range(3)}
    pq.write_table(pa.table({"doc_id": pa.array(texts, pa.int64()), "text": pa.array(texts.values(), pa.string())}), folder / "documents.parquet")
    return {i: t for i, t in sorted(texts.items()) if t is not None and len(t.encode()) > 2048}


def _fold_shift(text):
    c = 0
    for b in text.encode():
        c = (c << 1 & 0xFFFFFFFF) ^ b
        c ^= c >> 16
    return c


def test_object_read_of_every_large_object(spark, tmp_path):
    want = []
    for i, text in _large_texts(tmp_path).items():
        there = None if i % 7 == 3 else text[:-1] if i % 5 == 0 else text[::-1] if i % 5 == 1 else text
        want.append((i, "OK" if there == text else "IO_ERROR"))
    assert sorted(QUERIES["object_read"](spark, str(tmp_path)).select("seq", "status").collect()) == want
    sql = ORACLE_SQL["object_read"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")
    assert sorted(duckdb.connect().sql(sql).select("seq, status").fetchall()) == want


def test_object_write_of_every_large_object(spark, tmp_path):
    want, lba = [], 0
    for i, text in _large_texts(tmp_path).items():
        size = len(text.encode())
        want.append((i, lba, size, _fold_shift(text)))
        lba += -(-size // 4096) * 4096
    assert sorted(QUERIES["object_write"](spark, str(tmp_path)).select("seq", "lba", "size", "checksum").collect()) == want
    sql = ORACLE_SQL["object_write"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")
    assert sorted(duckdb.connect().sql(sql).select("seq, lba, size, checksum").fetchall()) == want
