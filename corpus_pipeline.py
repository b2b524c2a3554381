"""A corpus in five stages: toxicity, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept, which is written as Parquet
and read again. All stages but the last return the columns of ``documents``; the last repeats a row as often as the mix
takes it.

- toxicity: documents that the classifier chain rejects go. The chain learns from the stage's own documents and labels.
- near-duplicates: one document of each component stays, the one with the smallest id.
- decontamination: documents that hold a benchmark item within its error budget go.
- secrets: base spans and linked parts of texts become ``[secret]``; every document stays.
- mixing: sources are brought to their target weights by whole copies and Pareto order sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, mixing, neardup, scratch, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.model(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL does not express; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
