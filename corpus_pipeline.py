"""A training-data pipeline over ``documents``; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run`` writes every
stage as Parquet to the folder the cluster shares and hands the reread table on.

All stages but the last return the five columns of documents and drop others, whatever their names.  They judge
rows: equal rows, rows that share an id and rows without one are each a document.  A null text is an empty one.
Texts of any length are taken whole.  No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberscope.llm import decontaminate, mixing, near_dedup, quality, token_files
from emberscope.llm.shared import stage
from emberscope.session import Scratch, remove_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"
SIMILARITY = 80  # percent of shared runs of five words from which the stage takes two texts for copies


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules, each by its own text; null and empty texts have too few words and go."""
    return quality.passing(docs.select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id (null last), of equal rows any one.

    Rows without words are in no group and stay.
    """
    return near_dedup.without_near_duplicates(docs, SIMILARITY).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no test item, each judged by its own text; without test items, or without words, a row stays."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, shuffled within their shards; a null source is one of its own."""
    return mixing.shuffled(mixing.mix(docs.select(*COLUMNS)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each row the mix has taken; null ids come first, a text without words is its end id."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

ORACLE_SQL = None  # no SQL for MinHash components or tokenizers; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves behind is removed once the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            written = scratch.keep(f"pipeline-{name}")
        for folder in before:
            remove_folder(spark, folder)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
