"""The corpus pipeline: documents in, the documents of a training mix out.

Every stage takes the rows its predecessor kept and returns those that it
keeps, with the columns of ``documents``; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tidemark.llm.common import ROW, Scratch, keyed, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents of which nothing is left go."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_dedup.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth or more of their words in benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size and the words taken (repeats counted)."""
    rows = keyed(docs, "doc_id", Scratch(spark, "mixing-rows"))
    taken = mixing.mix_sources(rows, keep=(ROW,)).where("taken > 0").select(ROW, "size", "target", "taken")
    return rows.drop("size", "target", "taken").join(taken, ROW).drop(ROW)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: Trained models, signatures and sampling keys are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
