"""A corpus pipeline of five stages: toxic documents go, of each group of near duplicates one stays, documents that hold
benchmark items go, personal data is masked, and what is left is mixed to the target weights of overlapping sources.

Each stage takes all that the one before kept, written as Parquet in the shared folder and read again. All but the last
return the columns of documents, whatever these are; a column that no stage knows passes through. Every stage takes nulls in
any column, empty and very long texts, repeated rows and empty tables; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, mixing, pii, toxicity
from .common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, learned from ``labels``, does not predict toxic.

    Null and empty texts are judged by the bias alone; rows that repeat an id each by their own text; a score of exactly the
    threshold counts as toxic; without labels or without rows nothing goes.
    """
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by equal or similar texts the one with the smallest doc_id.

    Rows count one by one, also those that repeat an id or have none (null is the largest id; of ties any row stays); null and
    empty texts are alike to nothing and stay; an empty table stays empty.
    """
    return jaccard.kept(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no item of ``benchmark`` occurs, within the budget of edits.

    Null and empty texts hold nothing and stay; null and empty items occur nowhere; rows that repeat an id are judged by their
    own text; very long texts are searched whole; without items or without rows nothing goes.
    """
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every span of personal data replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null, texts without a span as they are; rows that repeat an id or a text are masked each; of spans that
    overlap the first one's kind stands for all; an empty table stays empty.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with ``copies``, how often. Sources overlap: a document's source and its language.

    A null source or language is a source as well; rows without a word are never taken; rows that repeat an id count one by
    one; equal rows are told apart by their place; an empty table stays empty.
    """
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: A learned score decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
