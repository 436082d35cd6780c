"""URL filters by Bloom filter cascades (operator 2).

A cascade answers membership of listed keys exactly for every key of a known
universe, here all keys that the corpus's urls can ask for. Level 0 is a Bloom filter
of the listed keys, level 1 one of the universe's keys that pass level 0 without
being listed, level 2 one of the listed keys that pass level 1, and so on until a
level has no wrong passes. The number of levels that a key passes tells its class.
(Larisch et al., "CRLite", IEEE S&P 2017.)

One pass over the universe finds level 0's false positives; all later levels work on
those alone. Level 0's rate is chosen from the sizes so that they number about as
many as the listed keys, so filters stay bounded by the list, and are broadcast only
below ``MAX_BITS``; a longer list is looked up by a hash join instead.

Rules say host suffix and path prefix; the longest that fits wins. Allow and block
rules have a cascade each, and a url is judged by its candidate keys (suffixes of as
many labels, prefixes of as many characters, as rules have). Where no rule fits, the
method's own verdict is that of a key that is not listed: allow.

Defined cases: a null url, or one without ``://``, has an empty host and path and is
allowed; equal rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordbytes import mix

#: Largest filter that is broadcast: 32 MB.
MAX_BITS = 1 << 28
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _pair(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, as two longs."""
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


class Bloom:
    """A Bloom filter of 128-bit hashes; level separates the cascade's filters."""

    def __init__(self, n: int, rate: float, level: int) -> None:
        self.level, self.n = level, n
        bits = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
        self.m = -(-bits // 64) * 64
        self.k = max(1, round(self.m / max(n, 1) * math.log(2))) if n * 64 > bits else max(1, math.ceil(-math.log2(rate)))
        self.words = np.zeros(self.m // 64, np.uint64)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        salt = np.uint64(self.level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        one, two = mix(a.view(np.uint64) ^ salt), mix(b.view(np.uint64) + salt) | np.uint64(1)
        return (one[:, None] + np.arange(self.k, dtype=np.uint64) * two[:, None]) % np.uint64(self.m)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)

    def fill(self, hashes: DataFrame) -> Bloom:
        """Bits of all rows of (a, b), merged by partial aggregation."""
        empty = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(empty.places(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                word, start = np.unique(at >> np.uint64(6), return_index=True)
                if len(word):
                    mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        merged = hashes.select("a", "b").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
        for row in merged.toLocalIterator():  # m / 64 rows at most
            self.words[row.word] = row.mask & (1 << 64) - 1
        return self


class Cascade:
    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe: listed keys pass an odd number of levels."""
        passed = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        for level in self.levels:
            alive = alive[level.has(a[alive], b[alive])]
            passed[alive] += 1
        return passed % 2 == 1

    @property
    def bits(self) -> int:
        return sum(x.m for x in self.levels)


def plan_rate(listed: int, universe: int) -> float:
    """Level 0's rate: about as many false positives as listed keys."""
    return min(0.5, max(1, listed) * math.sqrt(0.5) / max(1, universe))


def build(listed: DataFrame, universe: DataFrame, universe_size: int | None = None) -> Cascade | None:
    """A cascade for the distinct keys of ``listed`` among the keys of ``universe``.

    Both have a column ``key``. None if a filter would exceed MAX_BITS.
    """
    a, b = _pair(F.col("key"))
    listed = materialize(listed.where("key is not null").select("key", a.alias("a"), b.alias("b")).distinct())
    n = listed.count()
    if universe_size is None:
        universe_size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = plan_rate(n, universe_size)
    if -n * math.log(rate) / math.log(2) ** 2 > MAX_BITS:
        return None
    levels = [Bloom(n, rate, 0).fill(listed)]
    keys = universe.where("key is not null").select("key", a.alias("a"), b.alias("b"))
    others = _passing(keys, levels[0]).distinct().join(listed, "key", "left_anti")  # few: those that pass by chance
    others = materialize(others)
    inside, outside = listed, others
    for depth in range(1, 64):
        wrong = outside if depth % 2 else inside
        count = wrong.count()
        if not count:
            return Cascade(levels)
        level = Bloom(count, 0.5, depth).fill(wrong)
        if level.m > MAX_BITS:
            return None
        levels.append(level)
        if depth % 2:
            inside = materialize(_passing(inside, level))
        else:
            outside = materialize(_passing(outside, level))
    raise RuntimeError("the cascade does not end")


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(1).to_numpy(), batch.column(2).to_numpy()), pa.bool_()))

    return keys.select("key", "a", "b").mapInArrow(run, "key string, a long, b long")


def candidates(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Keys that rules could match: host suffix + path prefix, of the rules' sizes."""
    labels = sorted({r.split("/", 1)[0].count(".") + 1 for _, r in rules})
    sizes = sorted({len(r) - r.index("/") for _, r in rules})
    parts = F.split(host, r"\.", -1)
    out = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, -n, n), ".") if n > 1 else F.element_at(parts, -1)
        for size in sizes:
            fits = (F.size(parts) >= n) & (F.length(path) >= size) & (host != "")
            out.append(F.when(fits, F.concat(suffix, F.substring(path, 1, size))))
    return F.array_compact(F.array(*out))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    # The uniform name of a rule: a bare host stands for all its paths.
    rules = [(verdict, r if "/" in r else f"{r}/") for verdict, r in rules]
    parsed = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("keys", candidates(F.col("host"), F.col("path"), rules) if rules else F.array().cast("array<string>"))
    universe = parsed.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades = {}
    for verdict in ("allow", "block"):
        own = F.array(*[F.lit(r) for v, r in rules if v == verdict]).cast("array<string>")
        listed = spark.range(1).select(F.explode(own).alias("key"))
        cascades[verdict] = build(listed, universe, size)
    if None in cascades.values():
        return _judge_joined(parsed, rules)
    shared = spark.sparkContext.broadcast(cascades)
    parsed = parsed.withColumn("a", F.transform("keys", lambda k: _pair(k)[0])).withColumn("b", F.transform("keys", lambda k: _pair(k)[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, b = (batch.column(i) for i in (3, 4, 5))
            row = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            text, one, two = keys.flatten(), a.flatten().to_numpy(), b.flatten().to_numpy()
            rule, verdict, best = [None] * batch.num_rows, ["allow"] * batch.num_rows, [-1] * batch.num_rows
            for name, cascade in shared.value.items():
                for i in np.flatnonzero(cascade.has(one, two)).tolist():
                    key, r = text[i].as_py(), row[i]
                    if len(key) > best[r]:
                        best[r], rule[r], verdict[r] = len(key), key, name
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parsed.select("page_id", "host", "path", "keys", "a", "b").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _judge_joined(parsed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Beyond MAX_BITS: the rules as a table, met by a hash join."""
    spark = parsed.sparkSession
    table = spark.createDataFrame([(r, v) for v, r in rules], "key string, verdict string")
    found = parsed.select("host", "path", F.explode("keys").alias("key")).distinct().join(table, "key")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.length("key")).alias("best"))
    out = parsed.select("page_id", "host", "path").join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


_FITS = "\n".join(
    f"  {'CASE' if i == 0 else '    '} WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for i, (_, r) in enumerate(sorted(RULES, key=lambda x: -len(x[1])))
)
ORACLE = f"""
WITH tail AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM tail),
ruled AS (SELECT *,
{_FITS} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(repr(r) for v, r in RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
