"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Where a stage changes
texts, ``n_chars`` follows.

Defined cases, of each stage: an empty table gives an empty one; further columns are carried
through, whatever their names (the last stage returns its digests alone); texts of any length
are taken whole; repeated rows are rows each. Null and empty texts are rejected by the quality
rules, and where a stage meets them alone they stay; ids that are null have no labels, hold and
lose no lines, and are no one's copies. Ties are told by doc_id: a shared line stays in its largest,
a group of copies in its smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.bpe import bpe_digest
from chronoloom.llm.common import documents, stash
from chronoloom.llm.decontaminate import decontaminate
from chronoloom.llm.line_dedup import dedup_lines
from chronoloom.llm.near_dedup import keep_one
from chronoloom.llm.quality_rules import keep_good
from chronoloom.llm.queries import byte_bpe


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of before, n_chars counted anew."""
    return docs.select(*(F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay only in the largest doc_id."""
    return _recounted(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return _recounted(decontaminate(docs, documents(spark, sf_dir, "benchmark")), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_digest(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe),
]

#: The forest's verdicts have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
