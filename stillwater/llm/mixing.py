"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations alone.

Token weights of the (source, language, topic) cells are raked in turn to the three target
marginals until all three hold; a document is then drawn with its cell's calibrated probability.

The cell table grows with the levels of the marginals, not with the documents. It is broadcast to
the documents only where its counted rows are at most ``BROADCAST_CELLS``; beyond that documents
are joined on salted cells, so that a hot cell is never one task's work.

Defined results: a null level is a level of its own, ``(null)``; documents without tokens have
weight 1 (they carry none) and are kept; an empty table gives an empty table; repeated rows are drawn alike, by
their identifier; a text of any length counts its tokens whole; further columns, whatever their names, are kept by ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm.common import cut

DIMS = ("source", "lang", "topic")
BROADCAST_CELLS = 20_000
SALTS = 64


def genre(text: Column) -> Column:
    """The topic used where a table has none: the text's make-up over its whole length."""
    n = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.regexp_count(text, F.lit(r"[%$#&*]")) > 0.04 * n, "symbols")
        .when(F.regexp_count(text, F.lit(r"!!")) > 0.02 * n, "shouting")
        .when(F.regexp_count(text, F.lit(r"\|")) > 0.01 * n, "tables")
        .when(n < 600, "short prose")
        .otherwise("prose")
    )


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the levels and the tokens that raking reads, as __source, __lang, __topic and __tokens."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    level = {"source": docs["source"], "lang": docs["lang"], "topic": genre(text) if topic is None else topic}
    return docs.select(
        "*",
        *(F.coalesce(c.cast("string"), F.lit("(null)")).alias(f"__{k}") for k, c in level.items()),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("__tokens"),
    )


def target_share(cells: DataFrame, dim: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """__dim, share: the given shares, or else token shares raised to ``temper``; they add up to 1."""
    totals = cells.groupBy(f"__{dim}").agg(F.sum("tokens").alias("n"))
    if given:
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in given for x in (k, float(given[k])))), F.col(f"__{dim}")), F.lit(0.0))
    else:
        share = F.pow(F.col("n").cast("double"), F.lit(temper))
    raw = totals.filter("n > 0").select(f"__{dim}", share.alias("raw"))
    return raw.select(f"__{dim}", (F.col("raw") / whole(raw, F.sum("raw"))).alias(f"t_{dim}"))


def whole(rows: DataFrame, total: Column) -> Column:
    """An aggregate of all rows, one number, as a constant."""
    return F.lit(rows.agg(total).first()[0]).cast("double")


def rake(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.85, rounds: int = 24, tolerance: float = 1e-9) -> DataFrame:
    """__source, __lang, __topic, tokens, weight (calibrated over observed tokens), probability.

    Rounds end when every marginal is within ``tolerance`` of its target, or after ``rounds``
    (targets that no table with these empty cells can meet have no exact fit).
    """
    keys = [f"__{d}" for d in DIMS]
    cells = cut(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")))
    fit = cells.filter("tokens > 0")
    for d in DIMS:
        fit = fit.join(target_share(cells, d, (targets or {}).get(d), temper), f"__{d}")
    fit = cut(fit)
    if fit.count() <= BROADCAST_CELLS:
        fit = fit.coalesce(1)  # few rows
    everything = whole(fit, F.sum("tokens"))
    fit = fit.withColumn("w", F.col("tokens").cast("double") / everything)
    share = {d: F.sum("w").over(Window.partitionBy(f"__{d}")) for d in DIMS}
    for i in range(rounds):
        for d in DIMS:
            fit = fit.withColumn("w", F.when(share[d] > 0, F.col("w") * F.col(f"t_{d}") / share[d]).otherwise(0.0))
        if i % 3 == 2 or i == rounds - 1:
            fit = cut(fit)
            off = fit.select(F.greatest(*(F.abs(share[d] - F.col(f"t_{d}")) for d in DIMS)).alias("off")).agg(F.max("off")).first()[0]
            if off is None or off < tolerance:
                break
    weight = fit.select(*keys, "tokens", (F.col("w") * everything / F.col("tokens")).alias("weight"))
    return weight.select(*keys, "tokens", "weight", (F.col("weight") / whole(weight, F.max("weight"))).alias("probability"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, so that a retried task draws alike."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.85, seed: int = 17, topic: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __probability and __sampled."""
    keys = [f"__{d}" for d in DIMS]
    rows = described(docs, topic)
    cells = cut(rake(rows.select(*keys, "__tokens"), targets, temper)).select(*keys, F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))
    if cells.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(cells), keys, "left")
    else:
        salted = cells.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], "left").drop("__salt")
    joined = joined.withColumns({"__weight": F.when(F.col("__tokens") > 0, F.col("__weight")).otherwise(1.0), "__probability": F.when(F.col("__tokens") > 0, F.col("__probability")).otherwise(1.0)})
    return joined.withColumn("__sampled", uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed) < F.col("__probability"))


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    # whole rows go along as one column, so that theirs may have any name
    rows = docs.select(F.struct("*").alias("__row"), docs[id_col].alias("doc_id"), docs["text"], docs["source"], docs["lang"])
    return mixed(rows, **options).filter("__sampled").select("__row.*")
