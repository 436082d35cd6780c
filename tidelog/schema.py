"""Schemas and constants of the change log."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

PUT, DELETE = 0, 1
L0, L1, L2, L3 = range(4)
HOUR, DAY = 3600, 86400


class Policy(IntEnum):
    """How values are stored."""

    FASTEST = 0
    BALANCED = 1
    EXTREME_SPACE = 2


class Codec(IntEnum):
    NONE = 0
    DELTA_DELTA = 1
    BIT_PACKED = 2


LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ts", T.LongType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("tier", T.IntegerType(), False),
        T.StructField("window_start", T.LongType(), False),
        T.StructField("window_end", T.LongType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("min_key", T.BinaryType()),
        T.StructField("max_key", T.BinaryType()),
        T.StructField("max_seq", T.LongType(), False),
        T.StructField("policy", T.IntegerType(), False),
    ]
)
#: A file's entry: its value, or the entry whose value it shares, or its blob's hash.
ENTRY = T.StructType([*LOG.fields, T.StructField("orig", T.LongType()), T.StructField("hash", T.StringType())])
TAGGED = T.StructType([T.StructField("tag", T.StringType()), T.StructField("key", T.BinaryType())])
BLOB = T.StructType([T.StructField("hash", T.StringType()), T.StructField("codec", T.IntegerType()), T.StructField("data", T.BinaryType())])
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_type", T.ShortType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("payload", T.BinaryType()),
        T.StructField("checksum", T.LongType()),
    ]
)
