"""The corpus pipeline: each stage reads what the one before kept, written as Parquet.

Null and repeated doc_ids are rows like others, and further columns of documents travel along whatever they are called.
Of an empty table the first stages return an empty one, and packing no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import exact, jaccard, language, packing, phrases
from framelake.llm.common import documents, saved, workspace
from framelake.llm.tokens import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that aren't held out; texts without letters go, those of several languages
    stay, and those without a language get theirs."""
    return language.identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space folded) the smallest doc_id stays."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles with a similarity of 0.8 or more the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a smaller doc_id has are cut from the texts."""
    return phrases.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    return packing.pack(docs, tokenizer_path(), ids=False)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL has no Viterbi, and no tokenizer; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), workspace(spark)
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = saved(stage(spark, docs, sf_dir), f"{path}/{name}")
    return last(spark, docs, sf_dir)
