"""Scalar expressions: tiers, shards, key hashes, payloads. All are Catalyst expressions; only whole-value checksums are Arrow functions."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..config import DEFAULT, Config

U32 = 4294967295


def tier_of(size: Column, config: Config = DEFAULT) -> Column:
    return F.when(size <= config.tiny, "TINY").when(size <= config.medium, "MEDIUM").when(size.isNotNull(), "LARGE").otherwise("UNKNOWN")


def put_status(key: Column, size: Column, config: Config = DEFAULT) -> Column:
    """What a put says to key and size before anything is stored."""
    bad = key.isNull() | size.isNull() | (size <= 0)
    return F.when(bad, "ERROR").when(F.octet_length(key) > config.max_key_bytes, "INVALID_SIZE").otherwise("OK")


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))


def bytes_of(value: Column) -> Column:
    """The bytes of a string as an array of numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def fnv1a32(key: Column) -> Column:
    """FNV-1a, 32 bits, over signed bytes: those of 128 and more are sign-extended before the exclusive or."""
    signed = F.transform(bytes_of(key), lambda b: F.when(b >= 128, b.bitwiseOR(F.lit(4294967040))).otherwise(b))
    return F.aggregate(signed, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(U32)))


def knuth_bucket(key: Column, n: int) -> Column:
    """Multiplicative hash of a 32-bit key, mixed by two shifts, modulo n."""
    u32 = key.cast("long").bitwiseAND(F.lit(U32))
    h = (u32.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(20,0)") % F.lit(4294967296).cast("decimal(20,0)")).cast("long")
    h = h.bitwiseXOR(F.shiftright(h, 16))
    return h.bitwiseXOR(F.shiftright(h, 8)) % n


def payload(value: Column, config: Config = DEFAULT) -> Column:
    """Exactly payload_bytes bytes: cut, or padded with zero bytes."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    return F.rpad(F.substring(raw, 1, config.payload_bytes), config.payload_bytes, F.lit(b"\x00"))


def stored_value(value: Column) -> Column:
    """Zero means delete, so a put stores one instead."""
    return F.when(value == 0, F.lit(1)).otherwise(value)


def pack_record(request: Column, tier: Column) -> Column:
    """A request in the upper four bits of a byte, a tier in the lower four."""
    return F.shiftleft(request.bitwiseAND(F.lit(15)), 4).bitwiseOR(tier.bitwiseAND(F.lit(15)))


def request_of(packed: Column) -> Column:
    return F.shiftright(packed, 4).bitwiseAND(F.lit(15))


def record_tier(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(15))


def clamped_int(text: Column, low: int, high: int, default: int) -> Column:
    """A setting's number, or the default if it's none or out of range."""
    n = text.try_cast("int")
    return F.when(n.between(low, high), n).otherwise(F.lit(default))


def flag(text: Column) -> Column:
    """A setting's yes or no."""
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def pointer_is_valid(lba: Column, size: Column) -> Column:
    return (lba != 0) | (size != 0)


def pointers_equal(a: Column, b: Column) -> Column:
    """Same place and size, whatever the checksums."""
    return (a["lba"] == b["lba"]) & (a["size"] == b["size"])


#: Codecs by number.
CODECS = {0: "lz4", 1: "qpl", 2: "zlib_accel"}


def codec_name(codec: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair])[codec.cast("int")], F.lit("unknown"))


def safe_copy(text: Column, size: int) -> tuple[Column, Column]:
    """What fits a buffer of `size` bytes with its end mark, and 0, or -1 if that is not all of it."""
    return F.substring(F.encode(text, "UTF-8"), 1, size - 1), F.when(F.octet_length(text) >= size, -1).otherwise(0)


def next_value(key: Column, version: Column) -> Column:
    """The value of a key's version; never zero, as zero deletes."""
    value = key * 1009 + version + 1
    return F.when(value == 0, F.lit(1)).otherwise(value)


def plausible(key: Column, value: Column) -> Column:
    """Can value have been read for key? -1 is a miss; others are above the key's first value."""
    return (value == -1) | (value > key * 1009 + 1)


def plausible_in(low: Column, high: Column, value: Column) -> Column:
    """The same for any key of a range: the first one has the least bound."""
    return (value == -1) | ((low <= high) & plausible(low, value))


# --------------------------------------------------------------------------
# Checksums of whole values. Each is linear, so the values of a block of bytes are
# folded together in array steps, and a value longer than a block goes on from
# what its first blocks came to. Blocks are read from Arrow's own buffers: a task
# holds its batch and a block's steps, whatever the number and length of values.

#: Bytes of values that one array step handles at once; the steps take up to 60 times that.
BLOCK_BYTES = 256 << 10


@functools.lru_cache(64)
def _power(level: int) -> np.ndarray:
    """The linear map c -> x ^ (x >> 16) with x = c << 1, applied 2 ** level times, as a table for each of the four bytes."""
    if level:
        half = _power(level - 1)
        return np.stack([_apply(half, column) for column in half])
    place = (np.arange(256, dtype=np.uint64)[None] << (np.arange(4, dtype=np.uint64) * np.uint64(8))[:, None]) << np.uint64(1) & np.uint64(U32)
    return (place ^ (place >> np.uint64(16))).astype(np.uint32)


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _to_end(n: np.ndarray) -> np.ndarray:
    """For values of n bytes, one after another: each byte's distance to its value's end."""
    return np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1


def _in_blocks(fold, join, data: np.ndarray, n: np.ndarray, start: int = 0) -> np.ndarray:
    """A fold from start over the values of n bytes in data. fold: over a block's values from zero; join(c, n, x): c over n more bytes that come to x."""
    ends, out, at = np.cumsum(n), np.zeros(len(n), np.uint32), 0
    while at < len(n):
        first = int(ends[at] - n[at])
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK_BYTES, "right")))
        end, c = int(ends[to - 1]), np.full(to - at, start, np.uint32)
        for place in range(first, max(end, first + 1), BLOCK_BYTES):  # more than one place only if that's one longer value
            block = data[place : min(place + BLOCK_BYTES, end)]
            own = n[at:to] if end - first <= BLOCK_BYTES else np.array([len(block)])
            c = join(c, own, fold(block, own))
        out[at:to] = c
        at = to
    return out


def _shift_block(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Neighbours are merged from the end, level by level."""
    x, level = data.astype(np.uint32), 0
    while len(n) and n.max() > 1:
        to_end = _to_end(n)
        merged = (n + 1) // 2
        target = np.repeat(np.cumsum(merged), n) - 1 - to_end // 2
        left = to_end % 2 == 1
        out = np.zeros(merged.sum(), np.uint32)
        out[target[~left]] = x[~left]
        out[target[left]] ^= _apply(_power(level), x[left])
        x, n, level = out, merged, level + 1
    out = np.zeros(len(n), np.uint32)
    out[n > 0] = x
    return out


def _shift_join(c: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    for level in range(int(n.max()).bit_length() if c.any() else 0):
        c = np.where(n >> level & 1, _apply(_power(level), c), c)
    return c ^ x


def fold_shift(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """c = (c << 1) ^ byte, then c ^= c >> 16, over the bytes of each value."""
    return _in_blocks(_shift_block, _shift_join, data, n).astype(np.int64)


def _reduced(of: np.ufunc, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), x.dtype)
    some = n > 0
    if some.any():
        out[some] = of.reduceat(x, (np.cumsum(n) - n)[some])
    return out


def _rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    wide = x.astype(np.uint64) << (turn % 32).astype(np.uint64)
    return (wide ^ (wide >> np.uint64(32))).astype(np.uint32)


def _rotate_block(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A byte's rotation depends on its distance to the end modulo 32."""
    return _reduced(np.bitwise_xor, _rotated(data, _to_end(n)), n)


def fold_rotate(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """c = rotate-left(c, 1) ^ byte over the bytes of each value."""
    return _in_blocks(_rotate_block, lambda c, n, x: _rotated(c, n) ^ x, data, n).astype(np.int64)


@functools.lru_cache(8)
def _powers(base: int, most: int) -> np.ndarray:
    """base ** 0 to base ** most modulo 2^32."""
    return np.multiply.accumulate(np.append(np.uint32(1), np.full(most, base, np.uint32)), dtype=np.uint32)


def _polynomial(data: np.ndarray, n: np.ndarray, base: int, start: int) -> np.ndarray:
    """h = h * base + byte modulo 2^32 from start."""
    powers = _powers(base, BLOCK_BYTES)
    return _in_blocks(lambda x, n: _reduced(np.add, x.astype(np.uint32) * powers[_to_end(n)], n), lambda c, n, x: c * powers[n] + x, data, n, start)


def fold_31(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """h = h * 31 + byte modulo 2^31; zero becomes one."""
    return np.maximum((_polynomial(data, n, 31, 0) & np.uint32(0x7FFFFFFF)).astype(np.int64), 1)


def fold_33(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """h = h * 33 + byte in 32 bits with sign, from 5381; its absolute value plus one."""
    return np.abs(_polynomial(data, n, 33, 5381).view(np.int32).astype(np.int64)) + 1


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after another, as they lie in Arrow's buffer, and each value's number of bytes (of a null: any)."""
    values = values.cast(pa.large_binary())
    _, places, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values), np.int64)
    ends = np.frombuffer(places, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def folded(fold, values: pa.Array) -> pa.Array:
    """A fold of each of an Arrow batch's binary values; null of a null."""
    return pa.array(fold(*raw_bytes(values)), mask=values.is_null().to_numpy(zero_copy_only=False))


def _of(fold):
    @F.arrow_udf(LongType())
    def checksum(values: pa.Array) -> pa.Array:
        return folded(fold, values)

    return lambda value: checksum(value.cast("binary"))


checksum_shift, checksum_rotate, hash31, hash33 = map(_of, (fold_shift, fold_rotate, fold_31, fold_33))
