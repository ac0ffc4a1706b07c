"""The operators over the supplied tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import (
    conversations,
    decontaminate,
    fertility,
    language,
    licenses,
    lines,
    mix,
    periodic,
    records,
    repeats,
    simhash,
    toxicity,
    warc,
)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def second_vocabulary() -> fertility.RankFile:
    """The public vocabulary for many languages, as a file of ranks."""
    import public_tokenizers

    return fertility.RankFile(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures under two vocabularies and verdicts, by floors fitted to all documents labelled as good."""
    docs, first, second = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), second_vocabulary()
    return fertility.measure(docs, first, second=second, labels=table(spark, sf_dir, "labels"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return repeats.deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return records.read_records(spark, manifest)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, deleted lines and runs of every document, and the digest of what is kept."""
    rows = lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.records(warc.chunk_table(spark, warc.write_archives(pages), data=False))
    kind = pages.schema["page_id"].dataType
    return found.withColumns({c: found[c].cast(kind) for c in ("page_id", "refers_to")})


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of them with a periodic tail, and digests of the runs and of what they leave."""
    found = periodic.collapsed(periodic.with_tails(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic.longest(F.col("runs")))
    milli = 1000 * F.col("best.length")
    lines_of_runs = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        ((milli - milli % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines_of_runs, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = conversations.rebuilt(conversations.turn_table(table(spark, sf_dir, "conversations")))
    return conversations.trie(turns, ids)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate,
        op2_fertility,
        op3_mix,
        op4_suffix_array,
        op5_language,
        op6_licenses,
        op7_records,
        op8_lines,
        op9_warc,
        op10_simhash,
        op11_periodic,
        op12_conversations,
        op13_toxicity,
    )
    return {f.__name__: f for f in found}
