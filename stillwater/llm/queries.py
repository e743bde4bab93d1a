"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import bpe, exact_dedup, html_text, jaccard, labelled, mixing, neighbours, pii, quality, suffix, toxicity
from stillwater.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = labelled.remainder("doc_id", 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), rest != 0)
    return judged(quality.scored(docs, model), rest == 0)


def judged(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, calibrated weight, probability and draw."""
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(F.col(f"__{d}").alias(d) for d in mixing.DIMS), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), F.col("__sampled").alias("sampled"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = labelled.remainder("doc_id", 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), rest != 2)
    return judged(toxicity.scored(docs, model), rest == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_suffix": op3_suffix,
    "op4_html_text": op4_html_text,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op7_exact_dedup": exact_dedup.ORACLE}
