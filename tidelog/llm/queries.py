"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, hpylm, knn_quality, mixing, pii, secret_scan, simhash, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: op(*(_table(spark, sf_dir, t) for t in tables))

    return {
        "op1_surrogates": on(pii.pseudonymise, "documents"),
        "op2_bloom_cascade": on(url_filter.judge, "pages"),
        "op3_poisson_mix": on(mixing.poisson_mix, "documents"),
        "op4_learned_partitions": on(ann.ann_query, "embeddings"),
        "op5_template_decontamination": on(decontam.decontam_query, "documents", "benchmark"),
        "op6_suffix_sort": on(suffix_dedup.remove_repeats, "documents"),
        "op7_pitman_yor": on(hpylm.score_documents, "documents"),
        "op8_secret_scan": on(secret_scan.secret_query, "documents"),
        "op9_simhash_bktree": on(simhash.simhash_query, "documents"),
        "op10_knn_quality": on(knn_quality.quality_query, "documents", "labels"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_bloom_cascade": url_filter.ORACLE, "op3_poisson_mix": mixing.ORACLE}
