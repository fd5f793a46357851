"""The training-data pipeline: five operators of ``sardonyx.llm``, each on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the
last return the columns of ``docs``; the last writes the token ids and returns
one row per stored document.  ``run`` writes each stage's result below the
shared checkpoint folder as Parquet and reads it back as the next one's input.
The token ids themselves stay in an ORC folder there, which
``token_store.store_of`` names and ``token_store.read_tokens`` reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sardonyx.llm import decontaminate, mixing, quality, simhash, token_store
from sardonyx.llm.catalog import vocabulary
from sardonyx.llm.common import table
from sardonyx.session import delete_path, ensure_checkpoint_dir, scratch_scope, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly such passages go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are kept at the rates that bring the domains to their target weights."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written as ORC and read back: one row per stored document."""
    return token_store.store_and_digest(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage),
    ("mixing", mixing_stage), ("token_output", output_stage)]

#: Trees, fingerprints and merges are beyond SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as scope:  # a stage's own tables go when its result is written
            result = stage(spark, docs, sf_dir)
            path = scope.keep(write_table(result, f"pipeline-{name}"))
            if store := token_store.store_of(result):  # the product, not a table on the way to it
                scope.keep(store)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
