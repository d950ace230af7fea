"""From raw documents to packed training sequences: five stages, each written as Parquet and read again for the next.

All stages but the last return the columns of the documents, whatever further columns they have and however these are
named; an empty table gives an empty one. No stage is upset by nulls: a null text is an empty text, a null id is a document
of its own. Repeated rows share their verdict in the filters and are one document in ``near_dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm.common import materialize, table
from tarnflow.llm.near_dedup import drop_near_duplicates
from tarnflow.llm.packing import pack_documents
from tarnflow.llm.quality_rules import keep_good as keep_by_rules
from tarnflow.llm.secret_scan import redact
from tarnflow.llm.site_quality import keep_good as keep_by_site


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep. Null, empty and white-space texts have fewer than 50 words and go."""
    return keep_by_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality, with that of their host and path, is good; a posterior of exactly a half is good.
    Without labels of both kinds all stay."""
    return keep_by_site(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more, that of the smallest id.
    Texts without words resemble nothing and stay."""
    return drop_near_duplicates(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked and ``n_chars`` kept right; none goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens. An empty text is a piece of one id; equal pieces take
    places in any order."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: The label model, the classifier, MinHash groups, the forest and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
