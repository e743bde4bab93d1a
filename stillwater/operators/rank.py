"""Scores, rankings, leaders and roll-ups over report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]

#: What each leader is best in, and whether more is better.
LEADERS = {
    "score": True,
    "correlation_0_5_limit_fraction": True,
    "gradient_correlation": True,
    "unsupported_energy_fraction": False,
    "reconstruction_runtime_s": False,
}


def score(ssim: str = "ssim_global", gradient: str = "gradient_correlation", limit: str = "correlation_0_5_limit_fraction", false: str = "unsupported_energy_fraction") -> Column:
    return F.least(ssim, gradient, limit) * (1 - F.col(false))


def ranked(rows: DataFrame, by: str, ordinal: str, keys: Keys = (), out: str = "rank") -> DataFrame:
    """Rank from 1 by descending value, equal ones in input order. Without keys the ranks are of the whole (a report's few rows)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return rows.withColumn(out, F.row_number().over(w.orderBy(F.desc(by), ordinal)).cast("int"))


def leaders(rows: DataFrame, ordinal: str, name: str = "algorithm", metrics: dict[str, bool] | None = None) -> DataFrame:
    """metric, name, value: the best row of each metric among those that have it; the first row wins ties."""
    out = None
    for metric, more in (metrics or LEADERS).items():
        if metric not in rows.columns:
            continue
        best = rows.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric) if more else F.asc(metric), ordinal).limit(1)
        best = best.select(F.lit(metric).alias("metric"), F.col(name), F.col(metric).cast("double").alias("value"))
        out = best if out is None else out.unionByName(best)
    return out


def distinct_sorted(values: Column) -> Column:
    """All members of a group's arrays, once each, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(values))))


def first_kept(rows: DataFrame, by: Keys, ordinal: str) -> DataFrame:
    """The first row of each group of equals."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def repeated(rows: DataFrame, by: Keys) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def parameter_grid(rows: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every combination of the axes' values: a cross product with literals, no join."""
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return rows


#: Limitations that weigh more than medium, the level of all others.
HIGH_LIMITATIONS = ("not_spice_backed", "no_libration_or_orientation_solution", "not_earth_view_projected")
LEVELS = ("low", "medium", "high")


def level_rank(level: Column) -> Column:
    return F.when(level == "low", 1).when(level == "high", 3).otherwise(2)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in LEVELS)), rank)


def uncertainty(factors: DataFrame, keys: Keys, factor: str = "factor", level: str = "level") -> DataFrame:
    """Factors and the greatest severity of each group; an unknown level counts as medium."""
    return factors.groupBy(*keys).agg(F.array_sort(F.collect_set(factor)).alias("factors"), level_name(F.max(level_rank(F.col(level)))).alias("risk_level"), F.count(F.lit(1)).alias("n_factors"))


def limitation_level(limitation: Column) -> Column:
    return F.when(limitation.isin(*HIGH_LIMITATIONS), "high").otherwise("medium")


def registration_level(method: Column) -> Column:
    """Low for a constrained registration, medium for none or one unknown."""
    return F.when(method.isin("global_similarity_grid_search", "global_affine_grid_search", "integer_phase_correlation_translation"), "low").otherwise("medium")


def photometry_level(method: Column, applied: Column) -> Column:
    """Medium only where a fit was asked for and not applied."""
    return F.when((F.coalesce(method, F.lit("unknown")) == "none") | F.coalesce(applied, F.lit(False)), "low").otherwise("medium")
