"""Value sharing within files, and the content-addressed blob table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def share_values(entries: DataFrame) -> DataFrame:
    """kind raw for a value's first entry of a file, ref (to orig) for later equal ones.

    The first entries come from an aggregate, combined before it is shuffled, so a value
    that very many entries hold is never gathered; entries then join it by hash.
    """
    marked = entries.withColumn("value_hash", F.sha2(F.col("value").cast("binary"), 256))
    first = marked.groupBy("file_id", "value_hash").agg(F.min("seq").alias("orig"))
    found = first.select(F.col("file_id").alias("in_file"), F.col("value_hash").alias("of_hash"), "orig")
    same = (F.col("file_id") == F.col("in_file")) & F.col("value_hash").eqNullSafe(F.col("of_hash"))
    joined = marked.join(found, same).drop("in_file", "of_hash", "value_hash")
    return joined.withColumn("kind", F.when(F.col("seq") > F.col("orig"), "ref").otherwise("raw"))


def resolve_refs(shared: DataFrame) -> DataFrame:
    """Values of refs by a self-join on (file, orig); raw rows keep theirs."""
    raw = shared.where("kind = 'raw'").select("file_id", F.col("seq").alias("orig"), F.col("value").alias("raw_value"))
    return shared.drop("value").join(raw, ["file_id", "orig"], "left").withColumnRenamed("raw_value", "value")


def cas_put(rows: DataFrame, data: str, owner: str) -> DataFrame:
    """Distinct blobs by SHA-256, with the smallest owner."""
    return rows.groupBy(F.sha2(data, 256).alias("hash")).agg(F.min(owner).alias(owner))


def cas_new(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs (hash, data) that the table does not hold yet, one of each."""
    return blobs.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def cas_resolve(refs: DataFrame, cas: DataFrame, strict: bool = True) -> DataFrame:
    """Data of each referenced hash; a dangling one is an error if strict."""
    out = refs.join(cas, "hash", "left")
    if strict:
        out = out.withColumn("data", F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("missing blob "), F.col("hash")))))
    return out


def cas_garbage(cas: DataFrame, refs: DataFrame) -> DataFrame:
    """Blobs that nothing references."""
    return cas.join(refs.select("hash").distinct(), "hash", "left_anti")
