"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequery.llm import (
    collocations,
    decontaminate,
    jaccard,
    langid,
    negatives,
    packing,
    pieces,
    pii,
    quality,
    repeats,
    rules,
    sharding,
    topk,
)
from lorequery.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark, sf_dir):
    """The 5 largest inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.quantize(F.col("embedding"), 256).alias("vector")
    )
    return topk.largest_products(vectors.filter("id % 50 = 0"), vectors, 5)


def op2_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def op4_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def public_encoder() -> packing.BytePairEncoder:
    return packing.BytePairEncoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_encoder())


def op6_pieces(spark, sf_dir):
    """Ids of every whole text over the public pieces, as digests, and whether decoding gives the text back."""
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_rules(spark, sf_dir):
    ledger = rules.rule_ledger(table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"),
        rules.passes(rules.CURRENT).alias("kept"),
    )


def op8_quality(spark, sf_dir):
    statistics = quality.document_statistics(table(spark, sf_dir, "documents"))
    return quality.score(statistics, quality.fit(statistics, table(spark, sf_dir, "labels")))


def op9_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_pii(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "context")
    counts = [pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.encode(pii.listed(base), "UTF-8"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op11_collocations(spark, sf_dir):
    """The first 2000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def op13_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), moved.alias("label"), topk.quantize(F.col("embedding"), 256).alias("vector")
    )
    return negatives.hard_negatives(vectors, vectors.filter("id % 100 = 0"))


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_langid": op2_langid,
    "op3_sharding": op3_sharding,
    "op4_jaccard": op4_jaccard,
    "op5_packing": op5_packing,
    "op6_pieces": op6_pieces,
    "op7_rules": op7_rules,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_decontaminate": op12_decontaminate,
    "op13_negatives": op13_negatives,
}
