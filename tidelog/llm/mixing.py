"""Mixing sources to target weights by Poisson replication (operator 3).

Each document of source s is repeated Poisson(rate_s) times, where
rate_s = weight_s * target_rows / rows_s is the target repetition rate. The draw
inverts the Poisson distribution at a uniform number hashed from seed and
document, so a rerun after a lost executor repeats the same copies. Copies are
then dealt to partitions and ordered by a second hash: a global shuffle.

Everything is DataFrame functions. Per source only one row is aggregated; the
hot source is never gathered. A null source is a source of its own; rows with
equal doc_id share their draw; an empty table gives an empty result; a source
without weight, or weight <= 0, is left out, as its target share is zero; null and
very long texts pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED = "mix-1"


def _unit(*parts) -> F.Column:
    """Uniform in [0, 1) with 52 bits, from a hash of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _poisson(rate, u) -> F.Column:
    """The Poisson quantile at u: how many of the cumulative probabilities at 0, 1, ... are at most u.

    Summed up to where they round to 1, in time and memory linear in the rate, as are
    the copies that a draw makes.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.struct((-rate).alias("logp"), F.exp(-rate).alias("cum"), (F.exp(-rate) <= u).cast("int").alias("n"))

    def step(acc, k):
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        cum = acc["cum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cum.alias("cum"), (acc["n"] + (cum <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["n"])


def source_rates(docs: DataFrame, weights: dict | None = None, target_rows: int | None = None, key: str = "source") -> DataFrame:
    """(source, rows, rate): one row per source.

    weights: source -> relative weight; without it all sources weigh the same.
    target_rows: expected rows of the mix; without it as many as the weighted
    sources have.
    """
    spark = docs.sparkSession
    per = docs.groupBy(F.col(key).alias("mix_source")).agg(F.count("*").alias("mix_rows"))
    if weights is None:
        per = per.withColumn("mix_weight", F.lit(1.0))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "mix_name string, mix_weight double")
        per = per.join(table, F.col("mix_source").eqNullSafe(F.col("mix_name"))).drop("mix_name")
    per = per.where("mix_weight > 0")
    # Two scalars reach the driver; the table of sources itself stays distributed.
    all_weight, all_rows = per.agg(F.sum("mix_weight"), F.sum("mix_rows")).first()
    asked = float(target_rows if target_rows is not None else all_rows or 0)
    rate = F.col("mix_weight") / F.lit(float(all_weight or 1.0)) * F.lit(asked) / F.col("mix_rows")
    return per.withColumn("mix_rate", rate).select("mix_source", "mix_rows", "mix_rate")


def poisson_mix(
    docs: DataFrame, weights: dict | None = None, target_rows: int | None = None, key: str = "source", seed: str = SEED
) -> DataFrame:
    """``docs`` with each row repeated, plus ``copy`` (from 1) and ``shuffle_key``.

    Columns of ``docs`` with one of these two names give way; any others may clash with nothing.
    """
    # Written first, so that Spark knows its size and broadcasts it only if it is small.
    rates = materialize(source_rates(docs, weights, target_rows, key).select("mix_source", "mix_rate"))
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # The row travels as one field, so that its names can't meet those used here.
    rows = docs.select(F.struct(*names).alias("row"), F.col(key).alias("own_source"), doc.alias("doc"))
    drawn = rows.join(rates, F.col("own_source").eqNullSafe(F.col("mix_source")))
    # A hash is computed once, not for every step: projections of lambdas don't share it.
    drawn = drawn.withColumn("u", F.array(_unit(F.lit(seed), F.col("doc")))).withColumn("n", F.element_at(F.transform("u", lambda u: _poisson(F.col("mix_rate"), u)), 1))
    copies = drawn.where("n > 0").select("row", "doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "doc", F.col("copy").cast("string")))
    out = copies.select("row.*", "copy", order.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = f"""
WITH RECURSIVE per AS (SELECT source, count(*) n FROM documents GROUP BY source),
tot AS (SELECT sum(n)::DOUBLE all_rows, count(*)::DOUBLE w FROM per),
rate AS (SELECT source, 1.0::DOUBLE / w * all_rows / n AS r FROM per, tot),
steps(source, r, k, logp, cum) AS (
  SELECT source, r, 0, -r, exp(-r) FROM rate
  UNION ALL
  SELECT source, r, k + 1, logp + ln(r) - ln((k + 1)::DOUBLE), cum + exp(logp + ln(r) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(r + 12 * sqrt(r) + 30)
),
cdf AS (SELECT source, list(cum ORDER BY k) AS cums FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cums, lambda c: c <= ('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS m
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('{SEED}|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, m + 1)) AS copy FROM drawn WHERE m > 0)
"""
