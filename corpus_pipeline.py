"""From raw documents to token ids: toxic texts out, one text of each group of equals and near copies, sources mixed, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillwater.llm import bpe, exact_dedup, jaccard, labelled, mixing, toxicity
from stillwater.llm.common import cut, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a machine learnt as in the operator's query."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), labelled.remainder("doc_id", 4) != 2)
    return toxicity.clean(docs, model)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts: the one with the smallest identifier."""
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_copies_out), ("n-gram Jaccard join", near_copies_out), ("mixing", mixed), ("BPE", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are materialised before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
