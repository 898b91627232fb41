"""Corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its
result is written as Parquet and read again for the next one. All but the last return the columns
of documents.

Defined results: an empty table passes through every stage; null texts count as empty ones; texts of
any length are taken whole; of rows with one doc_id and text one stays, of near copies that with the
smallest doc_id; equal texts get equal scores and surrogates; further columns of any name pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import decontaminate, near, packing, quality, surrogates
from lakewright.llm.queries import SURROGATE_KEY, vocabulary
from lakewright.llm.shared import unused, written
from lakewright.session import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier accepts. It learns from the labelled rows of documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near.dedupe(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    found = surrogates.pseudonymise(docs, SURROGATE_KEY)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", untested),
    ("pii surrogates", private),
    ("best-fit packing", packed),
]

#: Neither compressed sizes nor token ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
