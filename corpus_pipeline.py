"""A corpus pipeline of the operators in ``provgraph.llm``; each stage takes what its predecessor kept.

In every stage texts are worked on in whole, however long, columns of ``docs`` beside ``COLUMNS`` are left out, whatever
their names, and empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provgraph.llm.common import scratch, table
from provgraph.llm.mixing import emit_copies, mix_sources
from provgraph.llm.quality import keep_quality
from provgraph.llm.secrets import redact
from provgraph.llm.simhash import near_duplicates
from provgraph.llm.tokens import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within their language's threshold; the others go.

    A perplexity equal to the threshold stays. Null or blank texts are scored by their end alone, a null language is one of
    its own, repeated rows stay or go together, and without any label all stay.
    """
    return keep_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels")).select(COLUMNS)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, a null one only if there is no other. Null, empty and blank texts are one group; repeated rows
    leave one.
    """
    return near_duplicates(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret in them replaced by a mark; none is left out.

    Null texts stay null, repeated rows are scanned each, and findings that overlap have one mark.
    """
    return redact(docs.select(COLUMNS)).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a document stands once for each copy taken.

    A null source is one of its own, last in order. Null and blank texts are taken at their source's rate and add no
    words. Repeated rows count each; ties in size and doc_id are broken by the text, so reruns agree.
    """
    return emit_copies(mix_sources(docs.select(COLUMNS)), COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to its text.

    A null text has null in all three results, an empty one no pieces. Repeated rows are encoded each.
    """
    encoded = encode(docs.select("doc_id", "source", "text"), check=True)
    return encoded.selectExpr("doc_id", "source", "ids", "cast(size(ids) as bigint) as n_pieces", "round_trip")


STAGES = [("quality", quality), ("deduplication", deduplication), ("secrets", secrets), ("mixing", mixing), ("pieces", pieces)]

#: The scores of the learned stages cannot be had in SQL. The tests hold counts and scores of quality and near-duplicates against plain
#: versions on small texts, and check what each stage keeps; no test holds the whole pipeline against one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
