"""Poisson replication: the draw against its definition, rare sources, clashing names."""

import collections
import hashlib
import math

from pyspark.sql import functions as F

from tidelog.llm import mixing


def quantile(rate, u):
    n, logp, cum, k = 0, -rate, math.exp(-rate), 0
    while cum <= u and k < rate + 12 * math.sqrt(rate) + 30:
        n, k = n + 1, k + 1
        logp += math.log(rate) - math.log(k)
        cum += math.exp(logp)
    return n


def test_draw_matches_definition(spark):
    rows = [(i, "text", "abc"[i % 3] if i % 7 else None, 1, "x") for i in range(300)] + [(None, None, "a", 2, "y"), (5, "", "b", 3, "z"), (5, "", "b", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_rate int, u string")
    weights = {"a": 5.0, "b": 0.5, "c": 0}
    got = mixing.poisson_mix(docs, weights, 900)
    assert got.columns == ["doc_id", "text", "source", "mix_rate", "u", "copy", "shuffle_key"]
    size = collections.Counter(r[2] for r in rows)
    want = collections.Counter()
    for i, _, source, *_ in rows:
        if weights.get(source):
            u = int(hashlib.md5(f"{mixing.SEED}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            want[i, source] += quantile(weights[source] / 5.5 * 900 / size[source], u)
    have = collections.Counter((r.doc_id, r.source) for r in got.collect())
    assert have == +want
    assert mixing.poisson_mix(docs.limit(0), weights, 900).count() == 0


def test_a_rare_source_takes_many_copies(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 7, "rare").otherwise("plenty").alias("source"), F.lit(1).alias("copy"), F.lit("").alias("Shuffle_Key"))
    got = mixing.poisson_mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()
    n = {r.source: r.n for r in got}
    assert abs(n["rare"] - 100_000) < 2000 and abs(n["plenty"] - 100_000) < 2000
    assert next(r.top for r in got if r.source == "rare") == n["rare"]
