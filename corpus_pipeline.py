"""The corpus pipeline: documents without toxic ones, one of each group of near copies, repeated passages and test items taken out, mixed to targets.

Defined cases: rows with a null, empty or blank text are no toxic ones (unless the classifier's bias says so), no copies and no leaks, so all stages keep them, and the mix takes nothing of
them; of rows alike in all columns one stays, of rows with equal texts the one with the least id (null ids count as largest, rows with equal ids by a hash of their columns); very long texts are read whole; a row that
loses all its words to repeats goes; further columns pass through unchanged, whatever their names, up to the mix; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import decontamination, jaccard_join, mixing, substring_dedup, toxicity
from dossier.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier learned from docs and the labels rejects."""
    return toxicity.drop_toxic(docs, toxicity.fit_on_folds(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.75 the one with the least id."""
    return jaccard_join.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand elsewhere too."""
    return substring_dedup.remove(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item."""
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("test items", drop_test_items),
    ("mixing", mix_sources),
]

#: Trained models and shingle components can't be said in SQL; tests/llm/test_pipeline.py holds every stage, and run(), against plain versions (the mix against its SQL).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
        discard(before)  # the mix, too, has written what it needs
    return docs
