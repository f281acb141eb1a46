"""A corpus pipeline: language, near-duplicates, benchmark passages, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import contamination, langid, mixing, queries, simhash, tokens
from ledgerlens.llm.rows import quoted
from ledgerlens.session import cut_lineage, scratch_path


def _only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*map(quoted, columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go."""
    profiles = langid.learn(docs.where(~queries.held_out()))
    found = langid.identify(docs, profiles)
    return _only(found.where(F.col("lang_pred") != langid.UNKNOWN), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = contamination.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    return _only(found.where(~queries.is_contaminated()), docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents in compressed token files."""
    path = tokens.write_tokens(docs, scratch_path(spark, "tokens"), queries.TOKENIZER)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_files", token_files),
]

#: Profiles, XXH64 fingerprints and token ids are not to be had in SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written before the next one reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
