"""A training corpus in five stages: quality, near-duplicates, benchmark copies, secrets, packing.

Each stage reads its predecessor's rows as written and reread Parquet;
all but the last keep the columns of ``documents``, whatever further columns
there are and however they are named. In every stage a null text is an empty
one (and stays null), rows with a null id are rows like any other, repeated
rows are judged alike (near-duplicates leave one of them), texts of any length
are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm import decontaminate, packing, quality, secrets, simhash
from segstats.llm.common import write_table
from segstats.llm.queries import END_ID, held_out, vocabulary_file
from segstats.sources.tables import load_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_accepted(docs, load_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, shingle=4, max_distance=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    found, name = decontaminate.with_matches(docs, load_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size(name) == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced; ``n_chars`` follows."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, vocabulary_file(), 4096, END_ID)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: Tokenizer, fingerprints and alignment are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}")
    return docs
