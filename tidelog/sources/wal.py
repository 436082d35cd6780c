"""The log's framed byte form: length, then operation, key, value and tags, little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..schema import DELETE, PUT


def _blob(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def encode(op: int, key: bytes, value: bytes | None = None, tags: list[str] | None = None) -> bytes:
    body = bytes([op]) + _blob(key)
    if op == PUT:
        body += _blob(value or b"") + struct.pack("<I", len(tags or [])) + b"".join(_blob(t.encode()) for t in tags or [])
    return _blob(body)


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, list[str]]]:
    """Records in order. A cut length at the end is a clean end, a cut record an error."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("torn record")
        at += 4 + size
        place = 1

        def blob() -> bytes:
            nonlocal place
            (n,) = struct.unpack_from("<I", body, place)
            place += 4 + n
            if place > len(body):
                raise ValueError("torn field")
            return body[place - n : place]

        op = body[0]
        if op not in (PUT, DELETE):
            raise ValueError(f"operation {op}")
        key = blob()
        if op == DELETE:
            yield op, key, None, []
            continue
        value = blob()
        (n,) = struct.unpack_from("<I", body, place)
        place += 4
        yield op, key, value, [blob().decode("utf-8", "replace") for _ in range(n)]


def split(data: bytes) -> Iterator[bytes]:
    """The frames' bodies in order, under the same rules as ``decode``."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            raise ValueError("torn record")
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


_RECORD = "op int, key binary, value binary, tags array<string>"


def read_wal(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """(file, seq, op, key, value, tags) of framed files, in order within each file; with a key each body is sealed."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame([(name, i, body) for i, body in enumerate(split(bytes(data)))], columns=["file", "seq", "body"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, i, *next(decode(_blob(bytes(body))))) for f, i, body in zip(batch.file, batch.seq, batch.body, strict=True)]
            yield pd.DataFrame(rows, columns=["file", "seq", "op", "key", "value", "tags"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    bodies = files.mapInPandas(cut, "file string, seq long, body binary")
    if key:
        bodies = bodies.withColumn("body", crypto.decrypt(F.col("body"), key))
    return bodies.mapInPandas(parse, f"file string, seq long, {_RECORD}")


def frames(rows: DataFrame, key: bytes | None = None) -> DataFrame:
    """(body) of each record (op, key, value, tags), by partition; with a key sealed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [
                encode(op, bytes(k), None if v is None else bytes(v), None if t is None else list(t))[4:]
                for op, k, v, t in zip(batch.op, batch.key, batch.value, batch.tags, strict=True)
            ]
            yield pd.DataFrame({"body": bodies})

    out = rows.select("op", "key", "value", "tags").mapInPandas(run, "body binary")
    return out.withColumn("body", crypto.encrypt(F.col("body"), key)) if key else out


def write_wal(rows: DataFrame, path: str, key: bytes | None = None) -> int:
    """Records as one framed file, in the order of ``rows``; returns how many.

    Such a file is one sequence of bytes, so partitions are streamed through the
    driver one after another; no more than one is held.
    """
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    n = 0
    try:
        for row in frames(rows, key).toLocalIterator():
            out.write(bytearray(_blob(bytes(row.body))))
            n += 1
    finally:
        out.close()
    return n
