"""A training corpus from the documents table, in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of documents:

1. toxicity: documents that the classifier rejects go; it is trained on the labelled ones;
2. exact dedup: one row of equal texts stays;
3. near dedup: one document of each group of near copies stays (sets of five-word shingles with a
   similarity of 0.80 or more; ``op4`` by itself links from 0.85);
4. mixing: sources are drawn to their target weights (a document may come twice);
5. sentencepiece: every text encoded and decoded; number of ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimforge.llm import exact_dedup, mixing, near_dups, pieces, toxicity
from claimforge.llm.common import read_table
from claimforge.session import drop_table, passing_tables


#: Similarity limit of the near-dedup stage, and the coordinates of 64 that a candidate pair agrees in: a pair
#: at the limit has fewer with a probability of about 1.2e-6.
NEAR_PERCENT, NEAR_MATCHES = 80, 35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_copies(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  What a stage has written for itself goes when its result is written, and
    so does its input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing_tables(spark) as keep:
            after = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop_table(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
