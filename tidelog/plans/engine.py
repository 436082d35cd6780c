"""The engine: a change log with files, tiers, blobs and a manifest under one folder.

Everything is Parquet read and written by Spark, so any store that Spark reads will
do. One writer at a time. A folder counts once its _SUCCESS exists, so a crash leaves
the state before the change:

- ``log/<first seq>``: one append each, numbered densely; deleted after the flush that
  covers it;
- ``files/<name>/rows`` and ``/tags``: a sorted file and its tag index;
- ``manifest/<version>``: the live files; the newest version holds;
- ``cas/<generation>``: blobs by hash; the newest generation holds.

With a key, records (operation, key, value, tags, time) are sealed as a whole, as are
tag indexes, blobs and the manifest's key bounds; only sequence numbers stay in clear.
"""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, crypto
from ..operators import dedup, files, state
from ..schema import BLOB, DELETE, ENTRY, L0, L1, L3, LOG, MANIFEST, PUT, TAGGED, Codec, Policy
from ..sources import wal
from ..streaming import bus

_logger = logging.getLogger(__name__)
_ONE = "op int, key binary, value binary, tags array<string>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None, policy: Policy = Policy.BALANCED) -> None:
        self.spark, self.root, self.key, self.policy = spark, root.rstrip("/"), key, policy
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        starts = self._numbered("log")
        last = self._read(f"log/{starts[-1]:020d}", self._stored(LOG)).agg(F.max("seq")).first()[0] if starts else None
        self._next = max(-1 if last is None else last, self._floor(self.manifest())) + 1

    # Storage -----------------------------------------------------------------
    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _numbered(self, folder: str) -> list[int]:
        """The complete numbered folders in ``folder``, in order."""
        if not self._exists(folder):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return sorted(int(n) for n in found if n.isdigit() and self._exists(f"{folder}/{n}/_SUCCESS"))

    def _read(self, names: str | list[str], schema: T.StructType) -> DataFrame:
        names = [names] if isinstance(names, str) else names
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[n if "://" in n or n.startswith("/") else f"{self.root}/{n}" for n in names])

    def _stored(self, schema: T.StructType) -> T.StructType:
        """The schema on disk: with a key all but the sequence number is one sealed field."""
        if not self.key:
            return schema
        clear = [f for f in schema if f.name == "seq"]
        return T.StructType([*clear, T.StructField("sealed", T.BinaryType())])

    def _hidden(self, rows: DataFrame) -> DataFrame:
        if not self.key:
            return rows
        inner = [c for c in rows.columns if c != "seq"]
        clear = [c for c in rows.columns if c == "seq"]
        return rows.select(*clear, crypto.encrypt(F.encode(F.to_json(F.struct(*inner)), "utf-8"), self.key).alias("sealed"))

    def _shown(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        if not self.key:
            return rows
        inner = T.StructType([f for f in schema if f.name != "seq"])
        clear = [f.name for f in schema if f.name == "seq"]
        return rows.select(*clear, F.from_json(F.decode(crypto.decrypt(F.col("sealed"), self.key), "utf-8"), inner).alias("r")).select(*clear, "r.*")

    def _load(self, names: str | list[str], schema: T.StructType) -> DataFrame:
        return self._shown(self._read(names, self._stored(schema)), schema)

    def manifest(self) -> list[Row]:
        versions = self._numbered("manifest")
        return self._load(f"manifest/{versions[-1]}", MANIFEST).collect() if versions else []  # one row per live file

    def _commit(self, rows: list) -> None:
        version = (self._numbered("manifest") or [0])[-1] + 1
        self._hidden(self.spark.createDataFrame(rows, MANIFEST)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")

    @staticmethod
    def _floor(rows: list[Row]) -> int:
        """The last sequence number that files cover."""
        return max((r.max_seq for r in rows), default=-1)

    def _tail(self, floor: int) -> tuple[DataFrame, list[int]]:
        """The log beyond ``floor``, and the starts of the appends read; older appends aren't listed."""
        starts = self._numbered("log")
        live = [s for i, s in enumerate(starts) if i + 1 == len(starts) or starts[i + 1] > floor + 1]
        return self._load([f"log/{s:020d}" for s in live], LOG).where(F.col("seq") > floor), live

    def _blobs(self) -> DataFrame:
        """(hash, data) of the newest generation, decoded."""
        now = self._numbered("cas")
        rows = self._load([f"cas/{now[-1]}"] if now else [], BLOB)
        return rows.select("hash", F.when(F.col("codec") == int(Codec.BIT_PACKED), codec.bit_unpack("data")).otherwise(F.col("data")).alias("data"))

    def _file_rows(self, rows: list[Row], where: Column | None = None) -> DataFrame:
        """Entries of these files, values resolved: one read of all their paths."""
        base = self._load([f"{r.path}/rows" for r in rows], ENTRY)
        hits = base if where is None else base.where(where)
        out = hits.where("orig is null and hash is null").select(*LOG.fieldNames())
        policies = {r.policy for r in rows}
        if Policy.BALANCED in policies:
            first = base.where("orig is null").select(F.col("seq").alias("orig"), F.col("value").alias("raw"))
            refs = hits.where("orig is not null").drop("value").join(first, "orig")
            out = out.unionByName(refs.withColumnRenamed("raw", "value").select(*LOG.fieldNames()))
        if Policy.EXTREME_SPACE in policies:
            refs = hits.where("hash is not null").drop("value")
            out = out.unionByName(dedup.cas_resolve(refs, self._blobs()).withColumnRenamed("data", "value").select(*LOG.fieldNames()))
        return out

    def _entries(self, key: bytes | None = None, where: Column | None = None) -> DataFrame:
        """All versions: of files (those whose bounds admit the key) and of the log's tail."""
        rows = self.manifest()
        if key is not None:
            where = F.col("key") == F.lit(key)
        tail, _ = self._tail(self._floor(rows))
        out = tail if where is None else tail.where(where)
        fit = [r for r in rows if key is None or not r.min_key or bytes(r.min_key) <= key <= bytes(r.max_key)]
        return out.unionByName(self._file_rows(fit, where)) if fit else out

    # Writes --------------------------------------------------------------------
    def append(self, rows: DataFrame) -> int:
        """(op, key, value, tags) rows in their order, as one atomic append; returns how many.

        Numbers are dense. Rows of one partition are numbered as they are; others are
        written first, and each partition starts after those before it.
        """
        ts = F.col("ts").cast("long") if "ts" in rows.columns else F.lit(int(time.time()))
        body = rows.select(F.col("op").cast("int").alias("op"), "key", "value", "tags", ts.alias("ts"))
        path, staged = f"{self.root}/log/{self._next:020d}", None
        if rows.rdd.getNumPartitions() <= 1:
            numbered = body.withColumn("seq", F.lit(self._next) + F.monotonically_increasing_id())
        else:
            staged = f"{self.root}/staged-{uuid.uuid4().hex}"
            place = F.monotonically_increasing_id()
            self._hidden(body.select(F.lit(0).cast("long").alias("seq"), place.alias("place"), *body.columns)).write.parquet(staged)
            schema = T.StructType([LOG["seq"], T.StructField("place", T.LongType()), *[f for f in LOG if f.name != "seq"]])
            held = self._load(staged, schema)
            part = F.shiftright("place", 33)
            # One row per partition of the input.
            counts = sorted(held.groupBy(part.alias("part")).count().collect())
            first, at = {}, self._next
            for r in counts:
                first[r.part], at = at, at + r["count"]
            starts = self.spark.createDataFrame(list(first.items()), "part long, first long")
            numbered = held.drop("seq").withColumn("part", part).join(F.broadcast(starts), "part").withColumn("seq", F.col("first") + F.col("place") % (1 << 33))
        self._hidden(numbered.select(*LOG.fieldNames())).write.mode("overwrite").parquet(path)
        if staged:
            self._delete(staged)
        n = self._read(path, self._stored(LOG)).count()  # footers only
        if not n:
            self._delete(path)
        self._next += n
        return n

    def put(self, key: bytes, value: bytes, tags: list[str] | tuple = ()) -> None:
        self.append(self.spark.createDataFrame([(PUT, key, value, list(tags))], _ONE).coalesce(1))

    def delete(self, key: bytes) -> None:
        self.append(self.spark.createDataFrame([(DELETE, key, b"", [])], _ONE).coalesce(1))

    def ingest(self, events: DataFrame) -> int:
        """Packs valid bus events into the log; returns how many."""
        good, _ = bus.split_valid(events)
        return self.append(bus.pack(good).withColumn("op", F.lit(PUT)))

    def ingest_stream(self, events: DataFrame, checkpoint: str):
        """A started query that checks, packs and appends each micro-batch of bus events.

        A batch that a failure repeats is appended again under later numbers, which
        leaves the same state.
        """
        return bus.ingest_stream(events, lambda batch, _: self.ingest(batch), checkpoint)

    def replay(self, path: str) -> int:
        """Appends the records of framed log files, in the order of file names; returns how many."""
        return self.append(wal.read_wal(self.spark, path, self.key).orderBy("file", "seq").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("file", "seq"))

    def write_wal(self, path: str) -> int:
        """The log's tail as one framed file, streamed in order; returns how many records."""
        tail, _ = self._tail(self._floor(self.manifest()))
        return wal.write_wal(tail.orderBy("seq"), path, self.key)

    # Reads ---------------------------------------------------------------------
    def get(self, key: bytes) -> bytes | None:
        row = state.get(self._entries(key), key).first()
        return bytes(row.value) if row else None

    def get_range(self, start: bytes, end: bytes) -> DataFrame:
        within = (F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end))
        return state.get_range(self._entries(where=within), start, end).select("key", "value")

    def get_by_tag(self, tag: str) -> DataFrame:
        """Live rows of keys that ever carried the tag, by the files' tag indexes and the log's tail."""
        rows = self.manifest()
        tail, _ = self._tail(self._floor(rows))
        keys = tail.where(F.array_contains("tags", tag)).select("key")
        if rows:
            keys = keys.unionByName(self._load([f"{r.path}/tags" for r in rows], TAGGED).where(F.col("tag") == tag).select("key"))
        return state.live(self._entries().join(keys.distinct(), "key", "left_semi")).select("key", "value")

    def scan(self) -> DataFrame:
        """The latest version of every key in key order, values resolved, tombstones included."""
        return state.latest(self._entries()).orderBy("key").select(*LOG.fieldNames())

    def get_blob(self, digest: str) -> bytes | None:
        """A blob by its SHA-256 in hexadecimal; None if the table has none."""
        row = self._blobs().where(F.col("hash") == digest).first()
        return bytes(row.data) if row else None

    def blob_refs(self) -> DataFrame:
        """Hashes that files refer to, one row per entry."""
        rows = [r for r in self.manifest() if r.policy == Policy.EXTREME_SPACE]
        return self._load([f"{r.path}/rows" for r in rows], ENTRY).where("hash is not null").select("hash")

    # Maintenance -----------------------------------------------------------------
    def _write(self, rows: DataFrame, name: str, policy: Policy) -> str:
        """A sorted file by the policy: plain values, values shared within the file, or blobs by hash."""
        path, staged = f"{self.root}/files/{name}", f"{self.root}/staged-{uuid.uuid4().hex}"
        self._hidden(rows).write.parquet(staged)  # merged once; sorting by range reads its input twice
        rows = self._load(staged, LOG).withColumn("orig", F.lit(None).cast("long")).withColumn("hash", F.lit(None).cast("string"))
        if policy == Policy.EXTREME_SPACE:
            data = F.coalesce("value", F.lit(b""))
            rows = rows.withColumn("hash", F.sha2(data, 256)).withColumn("value", data)
            self._put_blobs(rows.select("hash", F.col("value").alias("data")))
            rows = rows.withColumn("value", F.lit(None).cast("binary"))
        elif policy == Policy.BALANCED:
            shared = dedup.share_values(rows.drop("orig").withColumn("file_id", F.lit(0)))
            ref = F.col("kind") == "ref"
            rows = shared.withColumn("value", F.when(~ref, F.col("value"))).withColumn("orig", F.when(ref, F.col("orig")))
        tags = rows.select(F.explode("tags").alias("tag"), "key").distinct()
        self._hidden(tags.repartitionByRange("tag").sortWithinPartitions("tag", "key")).write.mode("overwrite").parquet(f"{path}/tags")
        ordered = rows.select(*ENTRY.fieldNames()).repartitionByRange("key").sortWithinPartitions("key")
        self._hidden(ordered).write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/rows")
        self._delete(staged)
        return path

    def _put_blobs(self, blobs: DataFrame) -> None:
        """Adds what the table lacks, series of numbers bit-packed."""
        now = (self._numbered("cas") or [1])[-1]
        fresh = dedup.cas_new(blobs, self._blobs())
        how = codec.choose(F.col("data"), Policy.EXTREME_SPACE)
        packed = F.when(how == int(Codec.BIT_PACKED), codec.bit_pack("data")).otherwise(F.col("data"))
        self._hidden(fresh.select("hash", how.cast("int").alias("codec"), packed.alias("data"))).write.mode("append").parquet(f"{self.root}/cas/{now}")

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def flush(self, name: str | None = None, window: int | None = None) -> None:
        """The log's tail becomes a level-0 file: the latest version of each key, in key order."""
        rows = self.manifest()
        tail, appends = self._tail(self._floor(rows))
        meta = tail.agg(F.min("key"), F.max("key"), F.max("ts"), F.max("seq")).first()
        if meta[3] is None:
            return
        path = self._write(_merge(tail), name or f"L0_{meta[3]}", self.policy)
        at = meta[2] if window is None else window
        self._commit([*rows, (path, L0, at, at, self._size(path), meta[0], meta[1], meta[3], int(self.policy))])
        for start in appends:
            self._delete(f"{self.root}/log/{start:020d}")

    def disk_usage(self) -> tuple[float, int]:
        """(share of the store in use, its size in bytes)."""
        status = self._fs.getStatus(self._path(self.root))
        total = max(1, status.getCapacity())
        return status.getUsed() / total, total

    def run_tiering_cycle(self, usage: float | None = None, total: int | None = None, threshold: float = 0.85) -> None:
        """Hourly files merge to level 1, daily ones to 2; then the coldest are evicted to 3.

        A group that fails is logged and left as it was. Without ``usage`` the store is asked.
        """
        for tier in (L0, L1):
            own = [r for r in self.manifest() if r.tier == tier]
            if not own:
                continue
            table = self.spark.createDataFrame([(i, r.window_start) for i, r in enumerate(own)], "file_id int, window_start long")
            for group in files.merge_candidates(table, tier).orderBy("bucket").collect():
                try:
                    self._compact([own[i] for i in group.file_ids])
                except Exception:
                    _logger.exception("merge of bucket %s of tier %s failed", group.bucket, tier)
        if usage is None or total is None:
            usage, total = self.disk_usage()
        self._evict(usage, total, threshold)

    def _compact(self, members: list[Row]) -> None:
        """Replaces files by their merge; the new one is committed before the old ones go."""
        tier, policy = members[0].tier, Policy.EXTREME_SPACE if members[0].tier == L1 else self.policy
        first, top = min(r.window_start for r in members), max(r.max_seq for r in members)
        version = (self._numbered("manifest") or [0])[-1] + 1
        path = self._write(_merge(self._file_rows(members)), f"compacted_L{tier}_{first}_{version}", policy)
        gone = {r.path for r in members}
        low, high = min(bytes(r.min_key) for r in members), max(bytes(r.max_key) for r in members)
        made = (path, min(tier + 1, L3), first, max(r.window_end for r in members), self._size(path), low, high, top, int(policy))
        self._commit([*[r for r in self.manifest() if r.path not in gone], made])
        for r in members:
            self._delete(r.path)

    def _evict(self, usage: float, total: int, threshold: float) -> None:
        rows = self.manifest()
        if usage < threshold or not rows:
            return
        table = self.spark.createDataFrame([(i, r.tier, r.window_start, r.size_bytes) for i, r in enumerate(rows)], "file_id int, tier int, window_start long, size_bytes long")
        cold = {r.file_id for r in files.evictions(table, usage, total, threshold).collect()}
        if not cold:
            return
        self._fs.mkdirs(self._path(f"{self.root}/cold"))
        moved = []
        for i, r in enumerate(rows):
            if i in cold:
                target = f"{self.root}/cold/{r.path.rsplit('/', 1)[1]}"
                self._copy(r.path, target)
                r = (target, L3, *tuple(r)[2:])
            moved.append(r)
        self._commit(moved)
        for i in cold:
            self._delete(rows[i].path)

    def _copy(self, source: str, target: str) -> None:
        """Rows and tag index as they are, so that the old folder serves until the commit."""
        for part in ("rows", "tags"):
            self.spark.read.parquet(f"{source}/{part}").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{target}/{part}")

    def run_cas_gc(self) -> int:
        """A new generation of the blob table without blobs that no file refers to; returns how many went."""
        now = self._numbered("cas")
        for old in now[:-1]:  # left by a crash
            self._delete(f"{self.root}/cas/{old}")
        if not now:
            return 0
        cas, refs = self._load(f"cas/{now[-1]}", BLOB), self.blob_refs().distinct()
        gone = dedup.cas_garbage(cas, refs).count()
        if gone:
            kept = cas.join(refs, "hash", "left_semi").select(*BLOB.fieldNames())
            self._hidden(kept).write.mode("overwrite").parquet(f"{self.root}/cas/{now[-1] + 1}")
            self._delete(f"{self.root}/cas/{now[-1]}")
        return gone

    def tier_sizes(self) -> DataFrame:
        return files.tier_sizes(self.spark.createDataFrame(self.manifest(), MANIFEST))

    def close(self) -> None:
        """Nothing is held open; here for callers that pair open and close."""


def _merge(rows: DataFrame) -> DataFrame:
    """The latest version of each key; tags of all its versions stay."""
    tags = rows.select("key", F.explode("tags").alias("tag")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("tag")).alias("all_tags"))
    merged = state.latest(rows).join(tags, "key", "left").withColumn("tags", F.coalesce("all_tags", F.array().cast("array<string>")))
    return merged.select(*LOG.fieldNames())
