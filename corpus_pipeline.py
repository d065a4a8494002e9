"""A corpus pipeline of five of the llm operators, as stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents, so each stage works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm import exact_dedup, jaccard, language, mixing, packing
from callgrain.llm._shared import written
from callgrain.llm.queries import vocabulary

#: A document is rejected if under this share of its letters is in its main language.
MAIN_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one main language; those without letters, or in no language for the most part, go.

    Learned from the stage's own labelled documents that are not held out, as the query does.
    """
    labelled = docs.filter(~language.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    told = language.identified(docs, language.learn(labelled))
    return told.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MAIN_LANGUAGE)).select("doc.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of linked documents the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a document taken twice is packed twice."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Language scores, flows and tokenisers have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
