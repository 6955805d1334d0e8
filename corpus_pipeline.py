"""The corpus pipeline: language ID, near-duplicate removal, redaction, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result as Parquet to the
shared folder and reads it again, so a lost executor costs a stage's tasks at most. What a stage wrote on its way, and its input, are deleted
once its result is written.

Nulls, empty texts, ties and repeated rows are as each stage's function in colonnade.llm.stages defines them; an empty table passes through
as an empty table, and other columns of documents are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import stages
from colonnade.session import drop_folders, scratch_folder, scratch_folders, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return stages.identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return stages.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the names of its kinds."""
    return stages.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, and one of each source cut, to meet the sources' targets."""
    return stages.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return stages.packed(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", jaccard_join), ("PII", personal_data), ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: Classifiers, components and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), scratch_folders()
    for _, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), scratch_folder(spark)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        drop_folders(scratch_folders() - before - {path})
    return STAGES[-1][1](spark, docs, sf_dir)
