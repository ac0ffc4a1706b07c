"""The training-data pipeline: five stages over documents, each over all that the one before has kept.

Defined results at every stage: empty tables give empty tables; repeated rows, nulls and long texts are treated as the
stage's operator says; columns besides those of ``documents`` stay on the rows until the last stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import decontaminate, fertility, mix, records, simhash
from windrow.llm.common import stored
from windrow.llm.queries import second_vocabulary, table, tokenizer_file


def labels_if_any(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels of the documents; a corpus may come without."""
    try:
        return table(spark, sf_dir, "labels")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language, with floors fitted to all labelled ones."""
    first, second = tokenizer_file("piece_bpe_32k.model"), second_vocabulary()
    return fertility.passed(docs, first, second=second, labels=labels_if_any(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark text occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix.resampled(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of token records: a row per record, read back from the files."""
    manifest = records.write_records(docs, tokenizer_file("word_bpe_49k.json"))
    return records.read_records(spark, manifest)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token records", token_records),
]

# Tokenisers, fingerprints and seeded draws are beyond SQL; tests/llm/test_outputs.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
