"""Immutable sorted files: manifests, zone maps, tag indexes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, HOUR, L0, L1, L3
from .state import latest


def manifest(entries: DataFrame, stamp: Column) -> DataFrame:
    """One row per file_id: distinct keys, key bounds and window; stamp in seconds."""
    return entries.groupBy("file_id").agg(
        F.countDistinct("key").alias("n_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max(stamp).alias("window_start"), F.max(stamp).alias("window_end")
    )


def may_hold(files: DataFrame, key, low: str = "min_key", high: str = "max_key") -> DataFrame:
    """Files whose key bounds admit the key; an unknown bound admits all."""
    k = F.lit(key)
    return files.where((F.col(low).isNull() | (F.col(low) <= k)) & (F.col(high).isNull() | (F.col(high) >= k)))


def tag_index(entries: DataFrame, tag: str = "tag") -> DataFrame:
    return entries.select("file_id", F.col(tag).alias("tag"), "key").distinct()


def merge_candidates(files: DataFrame, tier: int) -> DataFrame:
    """Buckets of a tier that hold more than one file: (bucket, n, file_ids)."""
    width = {L0: HOUR, L1: DAY}.get(tier)
    if width is None:
        return files.limit(0).groupBy(F.lit(0).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.collect_list("file_id").alias("file_ids"))
    bucket = F.expr(f"window_start div {width}")
    return files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("file_id")).alias("file_ids")).where("n > 1")


def compact(entries: DataFrame, *group: str) -> DataFrame:
    """Merge of files, of each group apart: the latest entry of each key, tombstones included."""
    return latest(entries, within=group)


def merged_meta(files: DataFrame, *group: str) -> DataFrame:
    """Bounds, window and tier of the file that replaces these, or those of each group."""
    return files.groupBy(*group).agg(
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.least(F.min("tier") + 1, F.lit(L3)).alias("tier"),
        F.min("min_key").alias("min_key"),
        F.max("max_key").alias("max_key"),
    )


def tier_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("tier").agg(F.sum("size_bytes").cast("long").alias("size_bytes"))


def evictions(files: DataFrame, usage: float, total: int, threshold: float) -> DataFrame:
    """Files to move to the coldest tier, coldest and oldest first, until usage is below the threshold.

    None if usage is below it already, or if even all files would not be enough. The
    window runs over the manifest alone.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("tier"), "window_start", "file_id")
    freed = F.lit(usage) - F.coalesce(F.sum("size_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(float(total))
    all_freed = F.lit(usage) - F.sum("size_bytes").over(Window.partitionBy()) / F.lit(float(total))
    ranked = files.where(F.col("tier") != L3).withColumn("left_before", freed).withColumn("left_at_last", all_freed)
    return ranked.where((F.lit(usage) >= threshold) & (F.col("left_before") >= threshold) & (F.col("left_at_last") < threshold)).drop("left_before", "left_at_last")
