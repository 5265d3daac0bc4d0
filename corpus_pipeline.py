"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import decontam, lines, packing, quality, setsketch
from voxloom.llm.shared import write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references.

    Null and empty texts fail (under 50 words); rows with a null id stay; of rows that share an id all must pass.
    """
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or one like it, taken out of the texts; the first by (doc_id, line) stays.

    A document of which only blank lines are left goes.  Null texts and rows with null ids stay as they are; rows that
    share an id are one document.
    """
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Documents without a word, and rows with a null id, are linked with nothing and stay.
    """
    return setsketch.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies inside a window of a benchmark item go.

    Null texts have no words and stay; rows equal in id and text share their fate; an empty benchmark removes nothing.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2048; token ids are hashed, not carried.

    A null or empty text is one piece, the end id; repeated rows are packed one by one.
    """
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_documents),
]

#: SQL cannot express registers, line similarity or packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
