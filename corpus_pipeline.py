"""Training-data pipeline: quality rules, toxicity, near duplicates, benchmark passages, tokens.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's ``docs``. All but the last keep exactly the columns of
``docs`` and drop rows; the last gives the token digests of what is left. Nulls, empty and repeated rows and
further columns are treated as each operator's docstring says. Nothing is left to SQL: ``ORACLE_SQL`` is None,
and the tests compare the rows with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkrisk.llm import bpe, decontam, quality_rules, simhash, toxicity
from sparkrisk.llm.common import Steps, let_workers_import
from sparkrisk.llm.queries import RANKS, read

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base rules or the likelihood ratio reject go."""
    let_workers_import(spark)
    ratios = quality_rules.fit_ratios(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    return quality_rules.keep_good(docs, ratios)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic go."""
    let_workers_import(spark)
    return toxicity.keep_civil(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the document of the smallest id of each component stays."""
    let_workers_import(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    let_workers_import(spark)
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: digests of the ids and of the decoded bytes of every document left."""
    let_workers_import(spark)
    return bpe.token_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_neardup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to shared storage, the one before deleted."""
    steps = Steps(spark, "pipeline")
    docs, old = read(spark, sf_dir, "documents"), ""
    for _, stage in STAGES:
        docs = steps.keep(stage(spark, docs, sf_dir))
        if old:
            steps.drop(old)
        old = steps.last
    return docs
