"""A corpus pipeline: each stage's documents are written as Parquet and reread as the next one's.

Cases, in every stage: null and empty texts are documents without words, very long texts are read whole, repeated rows are
rows of their own (repeats go in line dedup and near dedup, where the first row stays), ties are as in the operators'
docstrings, an empty table stays empty, and extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontaminate import decontaminated
from cairn.llm.line_dedup import dedup_lines
from cairn.llm.quality_classifier import accepted
from cairn.llm.runtime import spill, table
from cairn.llm.sentencepiece_codec import encoded
from cairn.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more; null and empty texts are judged by their bias."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those with no line of their own go, those without any stay."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; all null, empty and wordless texts are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents, and no passages of the benchmark in others; an empty benchmark changes nothing."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids; null and empty texts have none."""
    return encoded(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: No stage of trained weights, fuzzy lines or token ids is expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = spill(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
