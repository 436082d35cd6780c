"""Helpers shared by the operators: scratch tables, projections, byte chunks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    Only where it is unset in a local session (tests) a temporary folder is made; a
    cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, but compressed and columnar;
    a lost executor loses nothing. The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm.System.gc()  # lets Spark's cleaner delete shuffle files of lineage that has been cut
    out = spark.read.schema(df.schema).parquet(path)
    out.tidelog_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of plans that nothing holds any more."""
    spark.range(1).count()  # the session holds on to the plan that ran last
    gc.collect()  # drops the references that Python holds on the driver's objects
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # the cleaner works behind


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.tidelog_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_back(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per key, where a key may hold most rows.

    ``counts`` has (key, n). Keys with over a share of 1 / (4 x partitions) of all rows,
    of which there are 4 x partitions at most, are met by a broadcast, the others by a
    shuffle; so no task gets more rows than its share. ``rows`` is read twice.
    """
    spark = rows.sparkSession
    least = (counts.agg(F.sum("n")).first()[0] or 0) / (4 * parallelism(spark))
    hot = [r[0] for r in counts.where(F.col("n") > least).select(key).collect()]  # 4 x partitions at most
    if not hot:
        return rows.join(table, key, how)
    names = spark.createDataFrame([(x,) for x in hot], f"{key} {rows.schema[key].dataType.simpleString()}")
    big = rows.join(F.broadcast(names), key, "left_semi").join(F.broadcast(table.join(F.broadcast(names), key, "left_semi")), key, how)
    return big.unionByName(rows.join(F.broadcast(names), key, "left_anti").join(table, key, how))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, texts as UTF-8) of (doc_id, text) batches, about ``limit`` bytes at once."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        binary = batch.column(1).cast(pa.binary())
        for doc_id, scalar in zip(batch.column(0).to_pylist(), binary, strict=True):
            text = scalar.as_py() or b""
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 16
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def parallelism(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions to deal work to: what the session asks for its shuffles."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
