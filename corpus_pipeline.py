"""A training corpus from the documents table: toxic documents out, one of each group of near
duplicates, contaminated documents out, secrets masked, the rest packed.

Every stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of ``docs``.
Rows without doc_id cannot be named by a decision on near duplicates or contamination and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import decontaminate, neardup, packing, secrets, toxicity
from carelens.llm.catalog import tokenizer_file
from carelens.llm.common import hint_small, materialize, read_table

TOXIC_FROM = 0.5
SHINGLE_WORDS = 5


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``ids`` (its one column)."""
    name = "dropped_id"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    ids = ids.toDF(name)
    gone = materialize(ids.filter(F.col(name).isNotNull()).distinct(), "dropped")
    return docs.join(hint_small(gone, 16), F.col("doc_id") == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    name = "toxicity_score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return toxicity.with_scores(docs, model, name).filter(F.col(name) < TOXIC_FROM).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked at similarity 0.8 on word shingles."""
    groups = neardup.near_duplicates(docs, width=SHINGLE_WORDS)
    return _without(docs, groups.filter("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a window of a benchmark item."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("n_hit > 0").select("doc_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents (start and length among the document's ids) with their places
    in packed sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# The learned toxicity model is not expressible in SQL; tests/llm holds the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each reading what its predecessor wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
