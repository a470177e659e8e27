"""Corpus pipeline: five operators in a row over ``documents``, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet into the shared
folder and reads it again.  All but the last return the columns of ``documents``; the last adds the place of
each row in the mixture (block, slot, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from panelforge.llm._stage import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a letter, or whose language stays in doubt, go."""
    return language_id.keep(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of near-equal lines one stays; documents with no line left go; n_chars follows the text."""
    out = line_dedup.dedup(docs.select(*COLUMNS), drop_empty=True)
    return out.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in COLUMNS))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each linked group stays (five-word shingles, similarity 0.8)."""
    return jaccard_join.one_each(docs.select(*COLUMNS), k=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a copy of a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document gets its place in the mixture of sources."""
    return mixing.mix(docs.select(*COLUMNS), mixing.weight_of(F.col("source")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontaminate", remove_benchmark),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs


#: A trained model and fuzzy lines are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None
