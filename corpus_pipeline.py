"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate join, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next stage's documents.  All stages but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences.

Defined results, in every stage: a null text is an empty text (scored as one without words, an exact copy
of other empty texts, in no near-duplicate group, never taken by the mix, packed as its end id alone);
null ids are ids (they are kept last where the smallest stays, first dropped where the largest stays);
of ties one row stays, the same one in every run; rows that repeat id and text are one document to the two
duplicate stages; rows that share an id with other texts are documents of their own; further columns pass
through whatever their names (but for the last stage); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationlab.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from stationlab.llm.common import table, written

REJECT_FROM = 0.5
# word shingles of the near-duplicate stage: five words and a Jaccard of 0.8 (op9's query keeps its own 3 and 0.9)
SHINGLE = 5
PERCENT = 80


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is ``REJECT_FROM`` or more."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, index, REJECT_FROM)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest id of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of the five-word Jaccard join from 0.8 on."""
    return jaccard_join.one_per_component(docs, n=SHINGLE, percent=PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, packing.vocabulary_path(packing.VOCABULARY), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("source mix", source_mix),
    ("packing", pack),
]

# The toxicity scores (a calibrated vote of nearest neighbours) and the token ids have no SQL form;
# tests/llm/test_pipeline.py holds the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
