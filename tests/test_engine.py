import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, crypto, membership
from tidelog.operators import files
from tidelog.plans.engine import Engine
from tidelog.schema import L0, L1, L2, Policy
from tidelog.sources import wal
from tidelog.streaming import bus


def test_put_get_delete_reopen_and_tags(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.put(b"k1", b"v1", ["s1"])
    e.put(b"k2", b"v2", ["s1"])
    e.put(b"k3", b"v3", ["s2"])
    assert e.get(b"k1") == b"v1" and e.get(b"nope") is None
    assert {bytes(r.key) for r in e.get_by_tag("s1").collect()} == {b"k1", b"k2"}
    e.flush(window=1)
    e.put(b"k2", b"v2_new")
    e.delete(b"k3")
    e = Engine(spark, f"file://{tmp_path}/e")
    assert [(bytes(r.key), bytes(r.value)) for r in e.get_range(b"k1", b"k4").collect()] == [(b"k1", b"v1"), (b"k2", b"v2_new")]
    e.put(b"k1", b"")
    assert e.get(b"k1") is None  # an empty value is a tombstone


def test_tiers_cascade_blobs_and_encryption(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", key=b"k" * 16, policy=Policy.EXTREME_SPACE)
    for i, value in enumerate((b"one", b"two", b"three")):
        e.put(b"k", value, [f"t{i}"])
        e.flush(name=f"f{i}", window=3600 * 10 + i)
    e.run_tiering_cycle()
    (only,) = e.manifest()
    assert only.tier == L1 and "compacted_L0" in only.path
    assert e.get(b"k") == b"three"
    assert e.run_cas_gc() == 2 and e.run_cas_gc() == 0
    assert e.get(b"k") == b"three"
    assert [bytes(r.key) for r in e.get_by_tag("t0").collect()] == [b"k"]  # tags stay through merges
    with pytest.raises(Exception):
        Engine(spark, f"file://{tmp_path}/e", key=b"x" * 16).get(b"k")
    e.put(b"z", b"zz")
    e.flush(name="g", window=3600 * 12)
    e.put(b"z", b"yy")
    e.flush(name="h", window=3600 * 12 + 1)
    e.run_tiering_cycle()
    assert [r.tier for r in e.manifest()] == [L2]


def test_candidates_and_evictions(spark):
    rows = spark.createDataFrame([(0, 1000), (1, 1200), (2, 5000), (3, 5100)], "file_id int, window_start long")
    assert [r.file_ids for r in files.merge_candidates(rows, L0).orderBy("bucket").collect()] == [[0, 1], [2, 3]]
    sized = spark.createDataFrame([(0, 0, 10, 100), (1, 1, 20, 100), (2, 1, 10, 100), (3, 3, 0, 100)], "file_id int, tier int, window_start long, size_bytes long")
    assert [r.file_id for r in files.evictions(sized, 0.9, 1000, 0.85).collect()] == [2]
    assert files.evictions(sized, 0.8, 1000, 0.85).count() == 0
    assert files.evictions(sized, 0.99, 1000, 0.1).count() == 0  # all would not be enough


def test_codecs(spark):
    series = (1000 + 10 * np.arange(100, dtype="<u8")).tobytes()
    packed = codec.pack_bytes(series)
    assert len(packed) == 115 and codec.unpack_bytes(packed) == series
    wild = np.array([5, 3, 2**64 - 1, 0, 7, 9], "<u8").tobytes()
    assert codec.unpack_bytes(codec.pack_bytes(wild)) == wild
    row = spark.createDataFrame([(series,)], "v binary").select(codec.bit_unpack(codec.bit_pack("v")).alias("v")).first()
    assert bytes(row.v) == series
    got = spark.createDataFrame([(b"x" * 10,), (b"x" * 32,), (None,)], "v binary").select(codec.choose(F.col("v"), Policy.EXTREME_SPACE).alias("c")).collect()
    assert [r.c for r in got] == [0, 2, 0]


def test_membership_and_crypto(spark):
    assert membership.sizing(1000, 0.01) == (9600, 7)
    keys = spark.range(1000).withColumnRenamed("id", "key")
    bloom = membership.build(keys, "key", 9600, 7)
    assert membership.probe(keys, "key", bloom, 9600, 7).count() == 1000
    assert membership.probe(spark.range(10_000, 12_000).withColumnRenamed("id", "key"), "key", bloom, 9600, 7).count() < 40
    row = spark.createDataFrame([(b"secret",)], "v binary").withColumn("c", crypto.encrypt(F.col("v"), b"k" * 16))
    row = row.select(crypto.decrypt(F.col("c"), b"k" * 16).alias("a"), crypto.try_decrypt(F.col("c"), b"j" * 16).alias("b")).first()
    assert bytes(row.a) == b"secret" and row.b is None


def test_bus(spark, tmp_path):
    events = spark.createDataFrame([(123, 1, 456, b"\xbb" * 96), (124, 2, 457, b"x")], "event_id long, event_type short, timestamp long, payload binary")
    first = bus.pack(events).collect()[0]
    assert bytes(first.key) == struct.pack("<Q", 123)
    assert bytes(first.value) == b"\x01" + struct.pack("<Q", 456) + b"\xbb" * 96
    bad = bus.seal(events).withColumn("checksum", F.when(F.col("event_id") == 124, 0).otherwise(F.col("checksum")))
    good, dead = bus.split_valid(bad)
    assert [r.event_id for r in good.collect()] == [123] and [r.event_id for r in dead.collect()] == [124]
    assert [r.admitted for r in bus.admit(events, 1).orderBy("event_id").collect()] == [True, False]
    e = Engine(spark, f"file://{tmp_path}/e")
    assert e.ingest(bad) == 1 and e.get(struct.pack("<Q", 123))[0] == 1


def test_wal(spark, tmp_path):
    data = wal.encode(0, b"key1", b"v1", ["tag1"]) + wal.encode(0, b"key2", b"v2") + wal.encode(1, b"key1")
    assert [r[:2] for r in wal.decode(data)] == [(0, b"key1"), (0, b"key2"), (1, b"key1")]
    assert len(list(wal.decode(data + b"\x01\x00"))) == 3  # a torn length is the end
    with pytest.raises(ValueError):
        list(wal.decode(data[:-1]))
    (tmp_path / "a.wal").write_bytes(data)
    assert wal.read_wal(spark, f"file://{tmp_path}/a.wal").count() == 3


def test_wal_round_trip_sealed_and_replayed(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.put(b"a", b"1", ["t"])
    e.put(b"b", b"2")
    e.delete(b"a")
    for key in (None, b"k" * 16):
        path = f"file://{tmp_path}/{'sealed' if key else 'plain'}.wal"
        e.key = None
        assert wal.write_wal(e._tail(-1)[0].orderBy("seq"), path, key) == 3
        got = [(r.op, bytes(r.key), r.value and bytes(r.value), r.tags) for r in wal.read_wal(spark, path, key).orderBy("seq").collect()]
        assert got == [(0, b"a", b"1", ["t"]), (0, b"b", b"2", []), (1, b"a", None, [])]
    other = Engine(spark, f"file://{tmp_path}/f")
    assert other.replay(f"file://{tmp_path}/plain.wal") == 3
    assert other.get(b"a") is None and other.get(b"b") == b"2"


def test_numbers_are_dense_and_never_reused(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    one = "op int, key binary, value binary, tags array<string>"
    for value in (b"v1", b"v2"):  # one row in the first partition, so the first number is 0
        e.append(spark.createDataFrame([(0, b"k", value, [])], one).coalesce(1))
    assert e.get(b"k") == b"v2"
    e.flush(window=1)
    e.put(b"k", b"v3")
    assert e.get(b"k") == b"v3"
    e.delete(b"k")
    assert e.get(b"k") is None
    many = spark.range(1000, numPartitions=4).select(F.lit(0).alias("op"), F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"x").alias("value"), F.array().cast("array<string>").alias("tags"))
    assert e.append(many) == 1000 and e.append(many.limit(0)) == 0
    e.put(b"999", b"last")
    seqs = sorted(r.seq for r in e._entries().collect())
    assert seqs == list(range(1, 1005))  # number 0 was merged away
    e = Engine(spark, f"file://{tmp_path}/e")
    e.put(b"999", b"later")
    assert e.get(b"999") == b"later" and e.get(b"7") == b"x"


def test_put_flush_put_in_one_partition(tmp_path, spark):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.put(b"a", b"1")
    e.flush(window=1)
    assert Engine(spark, f"file://{tmp_path}/e").get(b"a") == b"1"
    e.put(b"a", b"2")
    e.delete(b"b")
    e = Engine(spark, f"file://{tmp_path}/e")
    assert e.get(b"a") == b"2"
    assert [(bytes(r.key), r.op) for r in e.scan().collect()] == [(b"a", 0), (b"b", 1)]


def test_same_bucket_twice_and_failed_group(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/e")

    def fill(n, window):
        e.put(f"k{n}".encode(), f"v{n}".encode(), ["t"])
        e.flush(window=window)

    fill(0, 36000), fill(1, 36001)
    e.run_tiering_cycle(0.0, 1)
    fill(2, 36000), fill(3, 36001)
    fill(4, 72000), fill(5, 72001)
    compact, failed = e._compact, []

    def fails_once(members):
        if not failed:
            failed.append(1)
            raise OSError("broken")
        return compact(members)

    monkeypatch.setattr(e, "_compact", fails_once)
    e.run_tiering_cycle(0.0, 1)
    assert failed and sum(r.tier == L0 for r in e.manifest()) == 2  # the other hour was merged
    e.run_tiering_cycle(0.0, 1)
    assert [bytes(r.value) for r in e.get_range(b"k0", b"k9").collect()] == [f"v{i}".encode() for i in range(6)]
    assert e.get_by_tag("t").count() == 6
    assert e.get_range(b"k3", b"k3").count() == e.get_range(b"k5", b"k1").count() == 0


def test_cycle_evicts_over_the_threshold(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    for i in range(2):
        e.put(b"k%d" % i, b"v%d" % i)
        e.flush(window=100_000 * (i + 1))
    sizes = [r.size_bytes for r in e.manifest()]
    e.run_tiering_cycle(usage=0.9, total=sum(sizes) * 8)  # the oldest file is enough
    assert sorted(r.tier for r in e.manifest()) == [L0, 3]
    assert "/cold/" in next(r.path for r in e.manifest() if r.tier == 3)
    assert e.get(b"k0") == b"v0" and e.get(b"k1") == b"v1"
    assert 0 < e.disk_usage()[0] <= 1


@pytest.mark.parametrize("policy", list(Policy))
def test_values_by_policy(spark, tmp_path, policy):
    e = Engine(spark, f"file://{tmp_path}/e", policy=policy)
    series = (1000 + 10 * np.arange(100, dtype="<u8")).tobytes()
    rows = [(0, f"k{i:03d}".encode(), series if i % 2 else b"shared value", ["t"]) for i in range(60)]
    e.append(spark.createDataFrame(rows, "op int, key binary, value binary, tags array<string>"))
    e.flush(window=1)
    stored = spark.read.parquet(f"{e.manifest()[0].path}/rows")
    assert stored.where("value is not null").count() == {Policy.FASTEST: 60, Policy.BALANCED: 2, Policy.EXTREME_SPACE: 0}[policy]
    assert stored.where("orig is not null").count() == (58 if policy == Policy.BALANCED else 0)
    assert {bytes(r.key): bytes(r.value) for r in e.scan().collect()} == {k: v for _, k, v, _ in rows}
    assert e.get(b"k059") == series and spark.read.parquet(f"{e.manifest()[0].path}/tags").count() == 60
    if policy == Policy.EXTREME_SPACE:
        import hashlib

        assert e.get_blob(hashlib.sha256(series).hexdigest()) == series and e.get_blob("0" * 64) is None
        assert e._read("cas/1", "hash string, codec int, data binary").where("codec = 2 and octet_length(data) = 115").count() == 1
        assert e.blob_refs().count() == 60


def test_nothing_is_stored_in_clear(spark, tmp_path):
    for policy in Policy:
        e = Engine(spark, f"file://{tmp_path}/{policy.name}", key=b"k" * 32, policy=policy)
        e.put(b"visible-key", b"visible-value", ["visible-tag"])
        e.flush(window=1)
        e.put(b"visible-key-2", b"visible-value", ["visible-tag"])
        stored = [p.read_bytes() for p in (tmp_path / policy.name).rglob("*.parquet")]
        assert stored and not any(b"visible" in x for x in stored)
        assert e.get(b"visible-key") == b"visible-value" and e.get_by_tag("visible-tag").count() == 2


def test_blob_garbage_survives_a_crash(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", policy=Policy.EXTREME_SPACE)
    for i, value in enumerate((b"one", b"two")):
        e.put(b"k", value)
        e.flush(window=36000 + i)
    e.run_tiering_cycle(0.0, 1)
    e._read("cas/1", "hash string, codec int, data binary").limit(0).write.parquet(f"{e.root}/cas/2")
    (tmp_path / "e/cas/2/_SUCCESS").unlink()  # a crash before the new generation was complete
    assert e.get(b"k") == b"two" and e.run_cas_gc() == 1 and e.get(b"k") == b"two"


def test_filter_as_bytes_and_by_join(spark, monkeypatch):
    keys = spark.range(500).withColumnRenamed("id", "key")
    bits, hashes = membership.sizing(500, 0.01)
    bloom = membership.build(keys, "key", bits, hashes)
    data = membership.to_bytes(bloom, bits)
    assert len(data) == bits // 8 and membership.to_bytes(membership.from_bytes(spark, data), bits) == data
    probes = spark.range(3000).withColumnRenamed("id", "key")
    packed = {r.key for r in membership.probe(probes, "key", bloom, bits, hashes).collect()}
    monkeypatch.setattr(membership, "MAX_LITERAL", 0)
    assert packed == {r.key for r in membership.probe(probes, "key", bloom, bits, hashes).collect()}
    assert set(range(500)) <= packed and len(packed) < 500 + 0.03 * 2500
