"""Exact dedup by content sort, with DataFrame operations alone.

Rows are range-partitioned by sampled splitters over their normalised text and sorted
externally, so equal texts are neighbours and are told apart by comparing whole texts.

Splitters hold at most ``PREFIX`` characters, a hash and a salt: what the driver samples stays
small however long the texts are. The salt deals a hot group out over ``salts`` runs; each run
is compared in full, and the runs of one content, a row each, are joined by their SHA-256.

Defined results: a null text is an empty text; all empty texts are one group; repeated rows
count as rows; a null identifier sorts before all others; of equal texts of one length the smallest identifier stays;
texts of any length are compared whole; further columns, whatever their names, are kept by ``dedup`` and not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm.common import cut, texts_of, with_ids

PREFIX = 48


def normalised(text: Column) -> Column:
    """A text without its white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = texts_of(docs, id_col, text_col).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.length("text").alias("n_code"),
        normalised(F.col("text")).alias("norm"),
    )
    rows = rows.select(
        "doc_id", "row", "n_code", "norm",
        F.substring("norm", 1, PREFIX).alias("head"),
        F.xxhash64("norm").alias("mark"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
    )
    run = Window.partitionBy("head", "mark", "salt", "norm")
    sorted_rows = rows.repartitionByRange("head", "mark", "salt").select(
        "doc_id", "row", "salt",
        F.min(F.struct((-F.col("n_code")).alias("fewer"), "doc_id", "row")).over(run).alias("best"),
        F.count(F.lit(1)).over(run).alias("n"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    small = cut(sorted_rows)
    runs = small.groupBy("text_sha256", "salt").agg(F.min("best").alias("best"), F.max("n").alias("n"))
    whole = runs.groupBy("text_sha256").agg(F.min("best").alias("keep"), F.sum("n").alias("group_size"))
    of_run = runs.select("text_sha256", "salt").join(whole, "text_sha256")
    return small.join(of_run, ["text_sha256", "salt"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, all columns kept.

    Where identifiers repeat, rows are matched by identifier and text, and of equal ones one stays.
    """
    groups = cut(exact_groups(docs, id_col, text_col))
    repeats = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = groups.filter("kept")
    if repeats.isEmpty():
        return with_ids(docs, kept.select("doc_id"), id_col)
    kept = kept.select("doc_id", "text_sha256")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # whole rows go along as one column, so that theirs may have any name
    marked = docs.select(F.struct("*").alias("whole"), docs[id_col].alias("own"), F.sha2(normalised(text), 256).alias("sha"), F.length(text).alias("n"), text.alias("t"))
    out = marked.join(kept, marked["own"].eqNullSafe(kept["doc_id"]) & (marked["sha"] == kept["text_sha256"]), "left_semi")
    first = Window.partitionBy("own", "sha").orderBy(F.desc("n"), "t")
    return out.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("whole.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
