"""The event bus: packing, bounded admission, batches, checks and streamed ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_MS = 5000


def little_endian(x: Column, width: int = 8) -> Column:
    """Bytes of a whole number, lowest first."""
    digits = F.lpad(F.hex(x), 2 * width, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))


def checksum(events: DataFrame) -> Column:
    return F.xxhash64("event_id", "event_type", "timestamp", "payload")


def seal(events: DataFrame) -> DataFrame:
    return events.withColumn("checksum", checksum(events))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): rows whose checksum fails do not hold up the rest."""
    good = F.coalesce(F.col("checksum") == checksum(events), F.lit(False))
    return events.where(good), events.where(~good)


def pack(events: DataFrame, *keep: str) -> DataFrame:
    """Entries of the log: key = id, value = type, timestamp and 96 payload bytes; ``keep`` names further columns."""
    payload = F.unhex(F.rpad(F.coalesce(F.hex("payload"), F.lit("")), 192, "0"))
    value = F.concat(little_endian(F.col("event_type"), 1), little_endian(F.col("timestamp")), payload)
    return events.select(*keep, little_endian(F.col("event_id")).alias("key"), value.alias("value"), F.array().cast("array<string>").alias("tags"))


def admit(events: DataFrame, capacity: int, order: str = "event_id", used: int = 0) -> DataFrame:
    """Events in order with ``admitted``: those that find room; later ones are dropped.

    Only the first ``capacity`` are ranked; the rest need no order.
    """
    room = max(0, capacity - used)
    first = events.orderBy(order).limit(room).select(F.col(order).alias("kept_id"))
    return events.join(first, F.col(order) == F.col("kept_id"), "left").withColumn("admitted", F.col("kept_id").isNotNull()).drop("kept_id")


def pop(events: DataFrame, limit: int, order: str = "event_id") -> DataFrame:
    """The first ``limit`` events in order; sealed ones whose checksum fails are passed over."""
    if "checksum" in events.columns:
        events = split_valid(events)[0]
    return events.orderBy(order).limit(limit)


def stats(head: Column, tail: Column, capacity: int, heartbeat_ms: Column, now_ms: int) -> list[Column]:
    """lag, bar cells of 20, percent and staleness."""
    lag = tail - head
    return [
        lag.alias("lag"),
        F.floor(lag / capacity * 20).cast("int").alias("bar"),
        (lag / capacity * 100).alias("percent"),
        ((heartbeat_ms > 0) & (F.lit(now_ms) - heartbeat_ms > STALE_MS)).cast("int").alias("stale"),
    ]


def dedup(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.dropDuplicates([key])


def ingest_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A started query that hands each micro-batch to the sink; offsets stand in for head and tail."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
