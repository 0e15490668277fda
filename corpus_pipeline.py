"""Training-corpus pipeline over ``documents``: five stages, each one operator of ``mailgauge.llm``.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; ``run``
writes each stage's rows to the shared scratch folder and reads them back for the next, so
a lost executor costs tasks, not stages.

Defined results: null texts are empty texts; extra columns of ``documents`` stay, whatever their names, until packing, which
returns only its own columns; rows without an id pass the copy stages as these say; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgauge.llm import exact_dedup, ngram_join, packing, pii, scratch, toxicity
from mailgauge.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Learnt from the labelled documents at hand outside the held-out part."""
    ship(spark)
    model = toxicity.fit(docs, scratch.table(spark, sf_dir, "labels"), lambda c: ~toxicity.held_out(c))
    name = scratch.fresh_name(docs, "score")
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles with similarity 0.8 or more the one with the smallest id."""
    ship(spark)
    return ngram_join.drop_near_copies(docs, width=5, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    ship(spark)
    return pii.redact(docs, pii.train(spark, pii.contexts_of(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    ship(spark)
    return packing.pack(packing.cut_pieces(docs))[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("pii", redact),
    ("best-fit packing", pack),
]

#: Models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        rows = scratch.saved(stage(spark, rows, sf_dir), f"stage-{k}")
    return rows
