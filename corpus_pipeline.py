"""The corpus pipeline: toxic documents, repeated lines and near duplicates go, benchmark passages are cut out, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.llm import decontaminate, lines, near, pieces, toxicity
from quillsearch.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars by the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator rejects; it is fitted on labelled documents among these."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays; a document that has no words left goes."""
    return _counted(lines.drop_lines(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near.drop_near(docs)


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that benchmark phrases cover."""
    return _counted(decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontamination", cut_leaks),
    ("sentencepiece", encode),
]

#: SQL has no automaton fitted on labels, SimHash or ProbMinHash; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
