"""Registered queries over the driver's tables, each with its SQL.

``events`` serve as a delta log: event_id is the sequence, user_id the key, props the
value (and tag), and an event of type error a tombstone.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, crypto, membership
from .operators import dedup, files, state
from .plans.engine import Engine
from .schema import HOUR, L0, L1, Policy
from .streaming import bus

AES_KEY = b"0123456789abcdef0123456789abcdef"

# Views -------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("op"),
        F.col("props").alias("value"),
        F.col("props").alias("tag"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
    )


def _in_files(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    return log(spark, sf_dir).withColumn("file_id", F.expr(f"seq div {size}"))


def _seconds():
    return F.expr("us div 1000000")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convex series per user: second differences of every bit width."""
    pos = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
    rows = log(spark, sf_dir).select("key", "seq").withColumn("pos", pos.cast("decimal(20,0)"))
    base = F.expr("cast(pow(key % 12, 9) as decimal(20,0)) + key")
    return rows.withColumn("v", (F.col("pos") * F.col("pos") * base).cast("decimal(38,0)"))


_LOG = """WITH log AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op,
  props AS value, props AS tag, epoch_us(ts) AS us FROM events),
files AS (SELECT *, seq // 500 AS file_id FROM log), fine AS (SELECT *, seq // 4 AS file_id FROM log)
"""
_LATEST = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_KEYED = ("key", "seq", "value")

# State ----------------------------------------------------------------------------


@_query(_LOG + f"SELECT key, seq, value FROM ({_LATEST.format(t='log')}) WHERE op = 0")
def q_replay_lww(spark, d):
    return state.live(log(spark, d)).select(*_KEYED)


@_query(_LOG + f"SELECT key, seq, value FROM ({_LATEST.format(t='log')}) WHERE op = 0 AND key = 13")
def q_get(spark, d):
    return state.get(log(spark, d), 13).select(*_KEYED)


@_query(_LOG + f"SELECT key, seq FROM ({_LATEST.format(t='log')}) WHERE op = 1")
def q_deleted_keys(spark, d):
    return state.latest(log(spark, d)).where("op = 1").select("key", "seq")


@_query(_LOG + f"SELECT key, seq, value FROM ({_LATEST.format(t='log')}) WHERE op = 0 AND key >= 10 AND key < 50")
def q_range(spark, d):
    return state.get_range(log(spark, d), 10, 50).select(*_KEYED)


@_query(_LOG + """, o AS (SELECT *, CASE WHEN file_id < 10 THEN 0 ELSE 1 END AS src FROM files)
SELECT key, seq, value FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY src DESC, seq DESC) = 1)
WHERE op = 0 AND key >= 10 AND key < 50""")
def q_range_override(spark, d):
    rows = _in_files(spark, d).where("key >= 10 and key < 50")
    both = state.overlay(rows.where("file_id < 10"), rows.where("file_id >= 10"))
    return state.live(both, "src", "seq").select(*_KEYED)


@_query(_LOG + f"""SELECT key, seq, value FROM ({_LATEST.format(t='log')}) WHERE op = 0
AND key IN (SELECT key FROM log WHERE tag = '{{"k": 87}}')""")
def q_by_tag(spark, d):
    return state.by_tag(log(spark, d), '{"k": 87}').select(*_KEYED)


@_query(_LOG + "SELECT DISTINCT file_id, tag, key FROM files")
def q_tag_index(spark, d):
    return files.tag_index(_in_files(spark, d))


@_query(_LOG + f"SELECT count(*) FILTER (op = 0)::BIGINT AS n_live, count(*) FILTER (op = 1)::BIGINT AS n_dead FROM ({_LATEST.format(t='log')})")
def q_snapshot_counts(spark, d):
    rows = state.latest(log(spark, d))
    return rows.agg(F.count_if(F.col("op") == 0).alias("n_live"), F.count_if(F.col("op") == 1).alias("n_dead"))


@_query(_LOG + "SELECT key, seq, value FROM (SELECT * FROM log WHERE seq <= 4999 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 0")
def q_asof_replay(spark, d):
    """Extension: state as it was after a sequence number."""
    return state.as_of(log(spark, d), 4999).select(*_KEYED)


@_query(_LOG + "SELECT key, seq, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def q_history(spark, d):
    """Extension: versions in both directions."""
    return state.history(log(spark, d))


# Files and maintenance ---------------------------------------------------------------


@_query(_LOG + "SELECT file_id, count(DISTINCT key) AS n_keys, min(key) AS min_key, max(key) AS max_key, max(us // 1000000) AS window_start, max(us // 1000000) AS window_end FROM files GROUP BY file_id")
def q_flush_manifest(spark, d):
    return files.manifest(_in_files(spark, d), _seconds())


@_query(_LOG + "SELECT file_id, min(seq) AS low, max(seq) AS high FROM files GROUP BY file_id HAVING min(seq) <= 742 AND max(seq) >= 742")
def q_zone_prune(spark, d):
    bounds = _in_files(spark, d).groupBy("file_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    return files.may_hold(bounds, 742, "low", "high")


@_query(_LOG + """, m AS (SELECT file_id, max(us // 1000000) AS window_start FROM files GROUP BY file_id)
SELECT key, seq, file_id FROM files JOIN m USING (file_id)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_id % 4, window_start DESC, file_id DESC, seq DESC) = 1""")
def q_get_file_priority(spark, d):
    rows = _in_files(spark, d)
    starts = rows.groupBy("file_id").agg(F.max(_seconds()).alias("window_start"))
    return state.first_hit(rows.join(starts, "file_id").withColumn("tier", F.expr("file_id % 4"))).select("key", "seq", "file_id")


def _candidates(spark, d, tier):
    fine = _in_files(spark, d, 4).groupBy("file_id").agg(F.max(_seconds()).alias("window_start"))
    return files.merge_candidates(fine, tier).select("bucket", "n", F.element_at("file_ids", 1).alias("first_id"), F.element_at("file_ids", -1).alias("last_id"))


_BUCKETS = """, m AS (SELECT file_id, max(us // 1000000) AS window_start FROM fine GROUP BY file_id)
SELECT window_start // {w} AS bucket, count(*) AS n, min(file_id) AS first_id, max(file_id) AS last_id FROM m GROUP BY 1 HAVING count(*) > 1"""


@_query(_LOG + _BUCKETS.format(w=3600))
def q_merge_candidates_hour(spark, d):
    return _candidates(spark, d, L0)


@_query(_LOG + _BUCKETS.format(w=86400))
def q_merge_candidates_day(spark, d):
    return _candidates(spark, d, L1)


_GROUPS = """, m AS (SELECT file_id, max(us // 1000000) AS w, min(key) AS a, max(key) AS b FROM fine GROUP BY file_id),
g AS (SELECT w // 3600 AS bucket FROM m GROUP BY 1 HAVING count(*) > 1)
"""


def _grouped(spark, d):
    """Files of the hourly merge groups, with their bucket."""
    metas = files.manifest(_in_files(spark, d, 4), _seconds()).withColumn("tier", F.lit(L0)).withColumn("bucket", F.expr(f"window_start div {HOUR}"))
    groups = files.merge_candidates(metas, L0).select("bucket")
    return metas.join(groups, "bucket", "left_semi")


@_query(_LOG + _GROUPS + """SELECT w // 3600 AS bucket, key, seq, op, value FROM fine JOIN m USING (file_id) WHERE w // 3600 IN (SELECT bucket FROM g)
QUALIFY row_number() OVER (PARTITION BY w // 3600, key ORDER BY seq DESC) = 1""")
def q_compact_group(spark, d):
    """The merge of every group of files that one hour holds."""
    rows = _in_files(spark, d, 4).join(_grouped(spark, d).select("file_id", "bucket"), "file_id")
    return files.compact(rows, "bucket").select("bucket", "key", "seq", "op", "value")


@_query(_LOG + _GROUPS + """SELECT w // 3600 AS bucket, min(w) AS window_start, max(w) AS window_end, 1 AS tier, min(a) AS min_key, max(b) AS max_key
FROM m WHERE w // 3600 IN (SELECT bucket FROM g) GROUP BY 1""")
def q_compact_meta(spark, d):
    return files.merged_meta(_grouped(spark, d), "bucket")


def _sized(spark, d):
    rows = _in_files(spark, d).groupBy("file_id").agg(F.max(_seconds()).alias("window_start"), F.sum(F.octet_length("value")).alias("size_bytes"))
    return rows.withColumn("tier", F.expr("cast(file_id % 4 as int)"))


_SIZED = ", m AS (SELECT file_id, max(us // 1000000) AS window_start, sum(strlen(value))::BIGINT AS size_bytes, (file_id % 4)::INTEGER AS tier FROM files GROUP BY file_id)\n"
_EVICT = _SIZED + """, r AS (SELECT *, 1.0::DOUBLE - coalesce(sum(size_bytes) OVER (ORDER BY tier DESC, window_start, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000.0::DOUBLE AS lb,
  1.0::DOUBLE - sum(size_bytes) OVER () / 100000.0::DOUBLE AS la FROM m WHERE tier <> 3)
SELECT file_id, tier, window_start, size_bytes FROM r WHERE lb >= {t} AND la < {t}"""


@_query(_LOG + _SIZED + "SELECT tier, sum(size_bytes)::BIGINT AS size_bytes FROM m GROUP BY tier")
def q_tier_sizes(spark, d):
    return files.tier_sizes(_sized(spark, d))


@_query(_LOG + _EVICT.format(t=0.9))
def q_evict(spark, d):
    return files.evictions(_sized(spark, d), 1.0, 100000, 0.9).select("file_id", "tier", "window_start", "size_bytes")


@_query(_LOG + _EVICT.format(t=0.10).replace("100000.0::DOUBLE", "1e12::DOUBLE"))
def q_evict_insufficient(spark, d):
    """On so large a store all files together would not free enough, so none go."""
    return files.evictions(_sized(spark, d), 1.0, 10**12, 0.10).select("file_id", "tier", "window_start", "size_bytes")


# Values ---------------------------------------------------------------------------------

_SHARED = ", s AS (SELECT *, min(seq) OVER (PARTITION BY file_id, value) AS orig FROM files)\n"


@_query(_LOG + _SHARED + "SELECT file_id, seq, orig, CASE WHEN seq > orig THEN 'ref' ELSE 'raw' END AS kind FROM s")
def q_value_sharing(spark, d):
    return dedup.share_values(_in_files(spark, d)).select("file_id", "seq", "orig", "kind")


@_query(_LOG + _SHARED + "SELECT file_id, count(*) AS n_entries, count(*) FILTER (seq = orig) AS n_raw, count(*) FILTER (seq > orig) AS n_ref FROM s GROUP BY file_id")
def q_value_sharing_savings(spark, d):
    rows = dedup.share_values(_in_files(spark, d))
    return rows.groupBy("file_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("kind") == "raw").alias("n_raw"), F.count_if(F.col("kind") == "ref").alias("n_ref"))


@_query(_LOG + "SELECT seq, value FROM log")
def q_ref_resolve(spark, d):
    return dedup.resolve_refs(dedup.share_values(_in_files(spark, d))).select("seq", "value")


@_query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def q_cas_put(spark, d):
    return dedup.cas_put(_documents(spark, d), "text", "doc_id")


def _cas(spark, d):
    return _documents(spark, d).select(F.sha2("text", 256).alias("hash"), F.col("text").alias("data")).dropDuplicates(["hash"])


@_query("SELECT doc_id, sha256(text) AS hash, strlen(text)::INTEGER AS n_bytes FROM documents")
def q_cas_resolve(spark, d):
    refs = _documents(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))
    return dedup.cas_resolve(refs, _cas(spark, d)).select("doc_id", "hash", F.octet_length("data").alias("n_bytes"))


@_query("SELECT doc_id, sha256(text) AS hash FROM documents")
def q_cas_refs(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@_query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def q_cas_gc(spark, d):
    """Blobs of all documents, of which the English ones are still referred to."""
    refs = _documents(spark, d).where("lang = 'en'").select(F.sha2("text", 256).alias("hash"))
    return dedup.cas_garbage(_cas(spark, d).select("hash"), refs)


_SERIES_LIKE = "strlen(text) >= 32 AND strlen(text) % 8 = 0"


@_query(f"SELECT doc_id, 0 AS fastest, 0 AS balanced, CASE WHEN {_SERIES_LIKE} THEN 1 ELSE 0 END AS balanced_codes, CASE WHEN {_SERIES_LIKE} THEN 2 ELSE 0 END AS extreme FROM documents")
def q_codec_choice(spark, d):
    t = F.col("text")
    return _documents(spark, d).select(
        "doc_id",
        codec.choose(t, Policy.FASTEST).alias("fastest"),
        codec.choose(t, Policy.BALANCED).alias("balanced"),
        codec.choose(t, Policy.BALANCED, balanced_codes=True).alias("balanced_codes"),
        codec.choose(t, Policy.EXTREME_SPACE).alias("extreme"),
    )


_DD = "CASE WHEN row_number() OVER w <= 2 THEN {v} ELSE {v} - 2 * lag({v}, 1) OVER w + lag({v}, 2) OVER w END"


@_query(_LOG + f"SELECT key, seq, {_DD.format(v='us')} AS dd FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def q_delta_delta(spark, d):
    return codec.delta_delta(log(spark, d), "us", "seq", "key").select("key", "seq", "dd")


@_query(_LOG + f"""SELECT key, seq, CASE WHEN x < 0 THEN x + 18446744073709551616::HUGEINT ELSE x END::VARCHAR AS dd
FROM (SELECT key, seq, ({_DD.format(v='us::HUGEINT')}) AS x FROM log WINDOW w AS (PARTITION BY key ORDER BY seq))""")
def q_delta_delta_wrapped(spark, d):
    rows = codec.delta_delta(log(spark, d), "us", "seq", "key")
    return rows.select("key", "seq", codec.wrapped(F.col("dd")).cast("string").alias("dd"))


@_query(_LOG + "SELECT key, seq, us FROM log")
def q_delta_delta_roundtrip(spark, d):
    coded = codec.delta_delta(log(spark, d), "us", "seq", "key").select("key", "seq", "dd")
    return codec.undo_delta_delta(coded, "seq", "key").select("key", "seq", F.col("v").alias("us"))


@_query(_LOG + f""", p AS (SELECT key, seq, (row_number() OVER (PARTITION BY key ORDER BY seq) - 1)::HUGEINT AS pos FROM log),
s AS (SELECT key, seq, pos, pos * pos * (pow(key % 12, 9)::HUGEINT + key) AS v FROM p),
x AS (SELECT key, pos, {_DD.format(v='v')} AS dd FROM s WINDOW w AS (PARTITION BY key ORDER BY seq)),
g AS (SELECT key, count(*) AS n, max(dd) FILTER (pos >= 2) AS top FROM x GROUP BY key),
b AS (SELECT key, n, CASE WHEN top <= 255 THEN 8 WHEN top <= 65535 THEN 16 WHEN top <= 4294967295 THEN 32 ELSE 64 END AS width FROM g)
SELECT key, n, width, (17 + (n - 2) * (width // 8))::BIGINT AS size_bytes FROM b""")
def q_bitpack_width(spark, d):
    coded = codec.delta_delta(_series(spark, d), "v", "seq", "key")
    top = coded.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("pos") >= 2, codec.wrapped(F.col("dd")))).alias("top"))
    out = top.withColumn("width", codec.bit_width(F.col("top")))
    return out.select("key", "n", "width", F.expr("cast(17 + (n - 2) * (width div 8) as bigint)").alias("size_bytes"))


@_query("SELECT event_id, props AS opened, NULL::VARCHAR AS wrong_key FROM events")
def q_encrypt_roundtrip(spark, d):
    sealed = _table(spark, d, "events").withColumn("sealed", crypto.encrypt(F.col("props").cast("binary"), AES_KEY))
    return sealed.select(
        "event_id", crypto.decrypt(F.col("sealed"), AES_KEY).cast("string").alias("opened"), crypto.try_decrypt(F.col("sealed"), AES_KEY[::-1]).cast("string").alias("wrong_key")
    )


@_query(_LOG + """, keys AS (SELECT DISTINCT key FROM log), probes AS (SELECT DISTINCT doc_id AS key FROM documents)
SELECT (SELECT count(*) FROM probes) AS n_probes, (SELECT count(*) FROM probes WHERE key IN (SELECT key FROM keys)) AS n_members, true AS none_lost, true AS few_false""")
def q_bloom_lookup(spark, d):
    """Every doc_id asked of a filter of the log's keys: members are never lost, at most 3 % of the others pass."""
    keys = log(spark, d).select("key").distinct()
    bits, hashes = membership.sizing(max(1, keys.count()), 0.01)
    probes = _documents(spark, d).select(F.col("doc_id").alias("key")).distinct()
    likely = membership.probe(probes, "key", membership.build(keys, "key", bits, hashes), bits, hashes).withColumn("likely", F.lit(True))
    marked = probes.join(likely, "key", "left").join(keys.withColumn("member", F.lit(True)), "key", "left")
    likely, member = (F.coalesce(c, F.lit(False)) for c in ("likely", "member"))
    n = marked.agg(F.count("*").alias("n_probes"), F.count_if(member).alias("n_members"), F.count_if(member & ~likely).alias("lost"), F.count_if(~member & likely).alias("false"))
    return n.select("n_probes", "n_members", (F.col("lost") == 0).alias("none_lost"), (F.col("false") <= 0.03 * F.col("n_probes") + 3).alias("few_false"))


# Bus -------------------------------------------------------------------------------------

_TYPE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _bus(spark, d):
    e = _table(spark, d, "events")
    return e.select(
        "event_id",
        F.expr(_TYPE).cast("short").alias("event_type"),
        F.expr("unix_micros(cast(ts as timestamp)) * 1000").alias("timestamp"),
        F.col("props").cast("binary").alias("payload"),
    )


def _le(x: str) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all(lpad(to_hex({x}), 16, '0'), '..')), '')"


@_query(f"""SELECT event_id, upper({_le('event_id')}) AS key_hex,
upper(lpad(to_hex({_TYPE}), 2, '0') || {_le('epoch_us(ts) * 1000')} || rpad(hex(props), 192, '0')) AS value_hex FROM events""")
def q_bus_pack(spark, d):
    packed = bus.pack(_bus(spark, d), "event_id")
    return packed.select("event_id", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@_query("SELECT least(count(*), 1024)::BIGINT AS admitted, greatest(count(*) - 1024, 0)::BIGINT AS overflow FROM events")
def q_bus_ring(spark, d):
    rows = bus.admit(_bus(spark, d).select("event_id"), 1024)
    return rows.agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("overflow"))


@_query("SELECT event_id FROM events ORDER BY event_id LIMIT 64")
def q_bus_pop(spark, d):
    return bus.pop(bus.seal(_bus(spark, d)), 64).select("event_id")


@_query("SELECT event_id FROM events")
def q_bus_dedup(spark, d):
    """Every event delivered twice."""
    events = _bus(spark, d).select("event_id")
    return bus.dedup(events.unionByName(events))


@_query("SELECT event_id FROM events WHERE event_id % 10 <> 7")
def q_bus_checksum(spark, d):
    """A tenth of the events arrives with a wrong checksum and goes to the dead letters."""
    sealed = bus.seal(_bus(spark, d))
    damaged = sealed.withColumn("checksum", F.when(F.col("event_id") % 10 == 7, F.col("checksum") + F.lit(1) - 2 * (F.col("checksum") > 0).cast("long")).otherwise(F.col("checksum")))
    return bus.split_valid(damaged)[0].select("event_id")


_NOW_MS = 1706659200000


@_query(f"""WITH s AS (SELECT 200::BIGINT AS head, least(count(*), 1024)::BIGINT AS tail, max(epoch_us(ts)) // 1000 AS beat FROM events)
SELECT (tail - head)::BIGINT AS lag, floor((tail - head) / 1024.0 * 20)::INTEGER AS bar, ((tail - head) / 1024.0::DOUBLE * 100)::DOUBLE AS percent,
CASE WHEN beat > 0 AND {_NOW_MS} - beat > 5000 THEN 1 ELSE 0 END AS stale FROM s""")
def q_bus_stats(spark, d):
    s = _bus(spark, d).agg(F.least(F.count("*"), F.lit(1024)).alias("tail"), F.expr("max(timestamp) div 1000000").alias("beat"))
    return s.select(*bus.stats(F.lit(200), F.col("tail"), 1024, F.col("beat"), _NOW_MS))


@_query(f"SELECT event_id FROM events WHERE upper({_le('event_id')}) >= '0A00000000000000' AND upper({_le('event_id')}) < '0C00000000000000'")
def q_le_range_order(spark, d):
    """A byte range of little-endian keys is no range of numbers."""
    le = F.hex(bus.little_endian(F.col("event_id")))
    return _bus(spark, d).where((le >= "0A00000000000000") & (le < "0C00000000000000")).select("event_id")


_ROOMS = itertools.count()


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared one; only a local session may lack that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    jvm = spark.sparkContext._jvm
    root = f"{base.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{next(_ROOMS)}"
    where = jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return root


@_query(f"""SELECT upper({_le('event_id')}) AS key_hex,
upper(lpad(to_hex({_TYPE}), 2, '0') || {_le('epoch_us(ts) * 1000')} || rpad(hex(props), 192, '0')) AS value_hex FROM events""")
def q_stream_ingest(spark, d):
    """Sealed bus events in four micro-batches through the engine's ingest, then a scan of its state."""
    root = _scratch(spark, "stream")
    sealed = bus.seal(_bus(spark, d))
    sealed.repartitionByRange(4, "event_id").write.parquet(f"{root}/events")
    engine = Engine(spark, f"{root}/engine")
    stream = spark.readStream.schema(sealed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    engine.ingest_stream(stream, f"{root}/checkpoint").awaitTermination()
    return engine.scan().select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


# Engine ----------------------------------------------------------------------------------


def _engine(spark, d, policy: Policy = Policy.BALANCED) -> Engine:
    """The whole log put in four appends: three flushed within an hour and merged, the last still in the log."""
    engine = Engine(spark, _scratch(spark, "engine"), policy=policy)
    rows = log(spark, d).select("seq", "op", F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.array("tag").alias("tags"))
    top = rows.agg(F.max("seq")).first()[0]
    if top is None:
        return engine
    bounds = [(top + 1) * i // 4 for i in range(5)]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        engine.append(rows.where((F.col("seq") >= low) & (F.col("seq") < high)).orderBy("seq").drop("seq"))
        if i < 3:
            engine.flush(window=HOUR * 10 + i)
    engine.run_tiering_cycle(0.0, 1)
    return engine


_TEXT_KEYS = "SELECT key::VARCHAR AS key, value FROM ({}) WHERE op = 0"


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@_query(_LOG + _TEXT_KEYS.format(_LATEST.format(t="log")))
def q_engine_scan(spark, d):
    """Append, flush, merge and scan: live rows of merged files under the log's tail."""
    return _plain(_engine(spark, d).scan().where("op = 0"))


@_query(_LOG + _TEXT_KEYS.format(_LATEST.format(t="log")) + " AND key::VARCHAR >= '2' AND key::VARCHAR < '5'")
def q_engine_range(spark, d):
    """The same over blobs by hash: keys as bytes in [2, 5)."""
    return _plain(_engine(spark, d, Policy.EXTREME_SPACE).get_range(b"2", b"5"))


@_query(_LOG + _TEXT_KEYS.format(_LATEST.format(t="log")) + """ AND key IN (SELECT key FROM log WHERE tag = '{"k": 87}')""")
def q_engine_by_tag(spark, d):
    return _plain(_engine(spark, d).get_by_tag('{"k": 87}'))
