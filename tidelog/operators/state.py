"""Last-writer-wins state: replay, point, range and tag reads, as-of and history.

A row is (seq, key, op, value, ...); the largest seq of a key wins. A tombstone is
op 1 or an empty value. Each read filters before it aggregates, so predicates on the
key reach the scan, and the aggregation combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE


def is_dead(op: str = "op", value: str = "value") -> Column:
    return (F.col(op) == DELETE) | F.coalesce(F.octet_length(F.col(value)) == 0, F.lit(True))


def latest(log: DataFrame, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key (of each group ``within``), by the largest ``order`` (seq unless given); tombstones stay."""
    order = order or ("seq",)
    own = [*within, "key"]
    rest = [c for c in log.columns if c not in own]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return log.groupBy(*own).agg(F.max_by(F.struct(*rest), by).alias("row")).select(*own, *[F.col(f"row.{c}").alias(c) for c in rest])


def live(log: DataFrame, *order: str) -> DataFrame:
    return latest(log, *order).where(~is_dead())


def get(log: DataFrame, key) -> DataFrame:
    return live(log.where(F.col("key") == F.lit(key)))


def get_range(log: DataFrame, start, end) -> DataFrame:
    """Live rows of [start, end), in key order."""
    return live(log.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))).orderBy("key")


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of both, those of ``top`` over those of ``base`` whatever their seq."""
    return base.withColumn("src", F.lit(0)).unionByName(top.withColumn("src", F.lit(1)))


def by_tag(log: DataFrame, tag: str, tags: str = "tag") -> DataFrame:
    """Live rows of keys that ever carried the tag."""
    has = F.array_contains(tags, tag) if log.schema[tags].dataType.typeName() == "array" else F.col(tags) == tag
    keys = log.where(has).select("key").distinct()
    return live(log).join(keys, "key", "left_semi")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live rows as they were after ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def history(log: DataFrame) -> DataFrame:
    """Each version with the seq of the one before and after it."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.select("key", "seq", F.lag("seq").over(w).alias("prev_seq"), F.lead("seq").over(w).alias("next_seq"))


def first_hit(entries: DataFrame) -> DataFrame:
    """Per key the entry of the first file by tier, newest window, then file and seq."""
    w = Window.partitionBy("key").orderBy("tier", F.desc("window_start"), F.desc("file_id"), F.desc("seq"))
    return entries.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
