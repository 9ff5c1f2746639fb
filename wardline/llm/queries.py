"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wardline.llm import (
    decontaminate,
    filter_audit,
    language_id,
    licenses,
    packing,
    quality,
    secret_scan,
    simhash,
    surrogates,
    token_counts,
    toxicity,
    url_rules,
    whitening,
)
from wardline.llm.common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": _over_documents(packing.op1_best_fit_packing),
        "op2_token_counts": _over_documents(token_counts.op2_token_counts),
        "op3_url_rules": lambda spark, sf_dir: url_rules.op3_url_rules(
            spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
        ),
        "op4_decontamination": lambda spark, sf_dir: decontaminate.op4_decontamination(
            read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        ),
        "op5_secret_scan": _over_documents(secret_scan.op5_secret_scan),
        "op6_license_scan": _over_documents(licenses.op6_license_scan),
        "op7_quality_rules": _over_documents(quality.op7_quality_rules),
        "op8_language_id": _over_documents(language_id.op8_language_id),
        "op9_surrogates": _over_documents(surrogates.op9_surrogates),
        "op10_simhash": _over_documents(simhash.op10_simhash),
        "op11_toxicity": lambda spark, sf_dir: toxicity.op11_toxicity(
            read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
        ),
        "op12_filter_audit": lambda spark, sf_dir: filter_audit.op12_filter_audit(
            read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
        ),
        "op13_whitening": lambda spark, sf_dir: whitening.op13_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op6_license_scan": licenses.op6_sql(),
        "op7_quality_rules": quality.op7_sql(),
        "op12_filter_audit": filter_audit.op12_sql(),
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
