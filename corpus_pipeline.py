"""From raw documents to packed sequences: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage works on all rows that the one before kept, judges whole texts, and leaves the columns as they are (the last returns pieces).

Edge cases, of all stages: an empty table gives an empty table with the same columns; rows with a null id or text are judged like
others (a null text scores 0, is no duplicate, leaks nothing, stays null, and is packed as its end id alone); repeated rows are judged each
and stay or go together; rows with one id and different texts are judged by their texts; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import Scratch
from lectern.llm.decontaminate import without_leaks
from lectern.llm.near_dedup import without_duplicates
from lectern.llm.packing import pack, piece_digests
from lectern.llm.pii import redacted_documents
from lectern.llm.toxicity import without_toxic

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    return redacted_documents(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences."""
    import public_tokenizers

    return piece_digests(pack(docs, public_tokenizers.path(VOCABULARY), END_ID))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: SQL has no network, walks or trees; tests/llm compares each stage with brute force or planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.clear(keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
