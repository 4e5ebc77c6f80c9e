"""Value compression and its statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType


def mapped(f, values: pa.Array) -> Iterator:
    """f of each binary value, read where it lies in Arrow's buffer; None of a null."""
    return (f(v.as_buffer()) if v.is_valid else None for v in values)


def compressor(level: int = 6):
    @F.arrow_udf(BinaryType())
    def compress(values: pa.Array) -> pa.Array:
        return pa.array(mapped(lambda v: zlib.compress(v, level), values), pa.binary())

    return compress


def compressed_sizes(values: pa.Array, level: int) -> pa.Array:
    return pa.array(mapped(lambda v: len(zlib.compress(v, level)), values), pa.int64())


def size_after(level: int = 6):
    """The compressed value's number of bytes; the value itself is dropped before the next one."""

    @F.arrow_udf(LongType())
    def size(values: pa.Array) -> pa.Array:
        return compressed_sizes(values, level)

    return size


@F.arrow_udf(BinaryType())
def decompress(values: pa.Array) -> pa.Array:
    return pa.array(mapped(zlib.decompress, values), pa.binary())


def ratios(sizes: DataFrame, by: str) -> DataFrame:
    """Sums of total and compressed bytes, ratio and saved_pct by group; zero bytes give zeros."""
    sums = sizes.groupBy(by).agg(F.sum("total").alias("total_bytes"), F.sum("compressed").alias("compressed_bytes"))
    ratio = F.when(F.col("compressed_bytes") > 0, F.col("total_bytes") / F.col("compressed_bytes")).otherwise(0.0)
    saved = F.when(F.col("total_bytes") > 0, (1 - F.col("compressed_bytes") / F.col("total_bytes")) * 100).otherwise(0.0)
    return sums.withColumns({"ratio": F.round(ratio, 6), "saved_pct": F.round(saved, 6)})
