"""Approximate membership: a Bloom filter as rows of 64-bit words."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a filter that a plan may carry.
MAX_LITERAL = 1 << 20


def sizing(n: int, rate: float) -> tuple[int, int]:
    """(bits, a multiple of 64; hashes)"""
    raw = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return -(-raw // 64) * 64, max(1, math.ceil(raw / n * math.log(2)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit("b"))
    size = F.lit(bits).cast("decimal(38,0)")
    at = lambda i: F.pmod(one.cast("decimal(38,0)") + i * two.cast("decimal(38,0)"), size).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: at(i.cast("decimal(10,0)")))


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): bits set, merged by partial aggregation."""
    at = keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("at"))
    word, bit = F.expr("at div 64"), F.expr("shiftleft(1L, cast(at % 64 as int))")
    return at.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))


def to_bytes(bloom: DataFrame, bits: int) -> bytes:
    """The filter as little-endian 64-bit words; ``bits`` is checked by the caller."""
    out = bytearray(bits // 8)
    for row in bloom.toLocalIterator():  # bits / 64 rows at most
        struct.pack_into("<Q", out, 8 * row.word, row.mask & (1 << 64) - 1)
    return bytes(out)


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """(word, mask) rows of ``to_bytes``; words without a bit are left out."""
    words = struct.unpack(f"<{len(data) // 8}q", data)
    return spark.createDataFrame([(i, w) for i, w in enumerate(words) if w], "word long, mask long")


def may_contain(key: Column, data: bytes, hashes: int) -> Column:
    """Whether all bits of a key are set, as one expression over the packed filter."""
    filled = F.lit(data)
    byte = lambda at: F.conv(F.hex(F.substring(filled, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(positions(key, 8 * len(data), hashes), lambda at: F.getbit(byte(at), (at % 8).cast("int")) == 1)


def probe(keys: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Keys that may be members: all their bits are set.

    A filter of at most ``MAX_LITERAL`` bytes is packed into the plan and tested where
    the keys lie; beyond that its words are met by a join.
    """
    if bits // 8 <= MAX_LITERAL:
        return keys.where(may_contain(F.col(key), to_bytes(bloom, bits), hashes)).select(key)
    distinct = keys.select(key).distinct()
    at = distinct.select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("at")).withColumn("word", F.expr("at div 64"))
    joined = at.join(bloom, "word", "left")
    hit = F.expr("coalesce((shiftrightunsigned(mask, cast(at % 64 as int)) & 1) = 1, false)")
    passed = joined.groupBy(key).agg(F.every(hit).alias("passes")).where("passes").select(key)
    return keys.select(key).join(passed, key, "left_semi")
