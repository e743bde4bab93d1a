"""Bounded samples of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import texts_of


def remainder(id_col: Column | str, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as an empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, longest: int = 200_000) -> tuple[list[tuple[str, int]], list[float]]:
    """Up to ``per_class`` (text, label) of either class, the same for the same tables, and each class's share of all labels.

    Only rows where ``learn`` holds are read. A document labelled more than once has the label most rows
    give it (1 on a tie). Texts over ``longest`` characters are not learnt from, which bounds the
    sample to the driver at 2 * per_class * longest characters; scores are given to all.
    """
    given = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(learn)
    given = given.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    texts = texts_of(docs).filter(F.length("text") <= longest)
    for y in (0, 1):
        want = given.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class + per_class // 8)
        some = texts.join(F.broadcast(want), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class)
        rows += [(r["text"], y) for r in some.select("text").collect()]
    total = max(1, sum(n.values()))
    return rows, [n.get(0, 0) / total, n.get(1, 0) / total]
