"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, token files.

Each stage works on all rows that the one before kept and gives back the columns
of ``documents``, but for the last, which gives the documents of the token files.
Between stages the rows are Parquet files in the shared folder. SQL can't
express the stages; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontaminate, mixing, near_dup, token_coder, toxicity
from tracelode.llm.queries import TOKENIZER
from tracelode.llm.scratch import cut

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the threshold; the model learns from labels of the rows at hand."""
    return toxicity.keep_mild(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage: no window of 13 words of an item in a row, and under a twentieth of words in
    shorter items, as those are found in clean texts by chance."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = (F.col("longest_hit") < decontaminate.WINDOW) & ~F.col("contaminated")
    return judged.where(clean).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix_rows(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_coder.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
