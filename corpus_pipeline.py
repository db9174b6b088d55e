"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequery.llm import jaccard, packing, pii, repeats, rules
from lorequery.llm.catalog import public_encoder
from lorequery.session import materialize, tidied


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of characters of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; rejected ones go."""
    return rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; documents of which nothing is left go."""
    return _counted(repeats.drop_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind in place of each piece of personal data."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of tokens."""
    return packing.pack_documents(docs, public_encoder())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", pack),
]
#: Tokens and repeated byte strings are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""

    @tidied
    def through(docs: DataFrame) -> DataFrame:
        for name, stage in STAGES:
            written = tidied(lambda docs, name=name, stage=stage: materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
            docs = written(docs)
        return docs

    return through(spark.read.parquet(f"{sf_dir}/documents.parquet"))
