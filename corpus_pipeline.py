"""From raw documents to token ids: five stages, each on all that the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns what the next one reads.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import stages

STAGES = [
    ("toxicity", stages.without_toxic),
    ("exact dedup", stages.without_copies),
    ("n-gram Jaccard join", stages.without_near_copies),
    ("mixing sources to target weights", stages.mixed),
    ("SentencePiece encoding and decoding", stages.encoded),
]

#: SQL can't score toxicity; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stages.stored(docs, "stage")
    return docs
