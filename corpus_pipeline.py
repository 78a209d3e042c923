"""From raw documents to packed training windows: toxicity, exact and near duplicates, mixture, packing.

Every stage takes all rows and columns of documents, extra ones too, whatever their names. Null and empty texts and
null doc_ids come through all filtering stages but count for no words, so they fill no window. Very long texts are
read whole. Ties and repeated rows are as the stage's operator has them. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from textloom.llm._tables import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field trained on the labels tags as toxic go; labels that are null or of no document don't count."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text, the row of the smallest doc_id stays; of null and of empty texts, one row each."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar n-grams, the one of the smallest doc_id stays; wordless texts stay."""
    return ngram_join.without_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the target weights, those of scarce sources in several epochs."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows are filled along walks over related documents."""
    return packing.packed(docs)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]
#: A trained field and greedy walks have no SQL; tests/llm (test_stages_decide) holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
