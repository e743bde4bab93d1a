"""Evaluation of reconstructions against a truth or a standalone reference, as one plan for all images."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.operators import estimate, pixel, rank, spectral

Keys = Sequence[str]


def against_truth(truth: DataFrame, reconstructions: DataFrame, keys: Keys, bins: int = 32, threshold: float = 0.5, cutoff: float = 0.6, multiplier: float = 1.5, diffraction: float | None = None, true_warp: DataFrame | None = None, warp: DataFrame | None = None) -> DataFrame:
    """One report row a reconstruction: similarity, structure, frequency recovery (with its curve), false detail, warp recovery, score."""
    pairs = pixel.paired(truth, reconstructions, keys)
    rows = pixel.metrics(pairs, keys)
    shared = [k for k in keys if k in truth.columns]
    curve = spectral.radial_curve(truth, reconstructions, keys, bins, spectral.dft_dense)
    limit = spectral.recovery_limit(curve, keys, threshold).withColumnRenamed("recovery_limit", "correlation_0_5_limit_fraction")
    beyond = spectral.beyond_diffraction(curve, keys, diffraction)
    high = pixel.paired(spectral.high_pass_dense(truth, shared, cutoff), spectral.high_pass_dense(reconstructions, keys, cutoff), keys)
    false = spectral.false_detail(high, keys, multiplier)
    columns = ["bin", "frequency_min_fraction", "frequency_max_fraction", "frequency_mid_fraction", "sample_count", "fourier_sample_count", "correlation", "phase_correlation", "amplitude_recovery"]
    bins_ = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("bins"))  # as many as there are bins
    for part in (limit, beyond, false, bins_):
        rows = rows.join(part, list(keys))
    if true_warp is not None and warp is not None:
        rows = rows.join(pixel.warp_error(true_warp, warp, keys), list(keys), "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast("double").alias(c) for c in ("mean_px", "median_px", "p95_px", "max_px")))
    relative = F.lit(None).cast("double") if not diffraction else F.col("correlation_0_5_limit_fraction") / diffraction
    return rows.withColumns({"cutoff_fraction": F.lit(cutoff), "support_multiplier": F.lit(multiplier), "diffraction_frequency_fraction_of_nyquist": F.lit(diffraction).cast("double"), "correlation_0_5_limit_relative_to_diffraction": relative, "score": rank.score()})


def nested(rows: DataFrame, keys: Keys) -> DataFrame:
    """Report rows in the nested form that is stored."""
    return rows.select(
        *keys,
        F.struct("mse", "psnr_db", "ssim_global").alias("image_similarity"),
        F.struct("gradient_correlation").alias("structural_accuracy"),
        F.struct("bins", "correlation_0_5_limit_fraction", "diffraction_frequency_fraction_of_nyquist", "correlation_0_5_limit_relative_to_diffraction", "mean_correlation_beyond_diffraction").alias("frequency_recovery"),
        F.struct("cutoff_fraction", "support_multiplier", "unsupported_energy", "signed_residual_energy", "total_high_frequency_energy", "unsupported_energy_fraction").alias("false_detail"),
        F.when(F.col("mean_px").isNotNull(), F.struct("mean_px", "median_px", "p95_px", "max_px")).alias("warp_recovery"),
        "score",
    )


def registered(reference: DataFrame, images: DataFrame, keys: Keys, method: str = "none", **grid) -> DataFrame:
    """The images moved onto the reference: not at all, by whole pixels, or by the best candidate of a grid."""
    from stillwater.operators import gather

    if method == "none":
        return images
    if method == "integer_phase_correlation_translation":
        moved = estimate.shifts(reference, images, keys)
        field = images.select(*keys, "y", "x").join(moved, list(keys)).select(*keys, "y", "x", (-F.col("shift_u")).cast("double").alias("u"), (-F.col("shift_v")).cast("double").alias("w_v"))
        return gather.warped(images, field, keys)
    if method == "grid":
        best = estimate.registration(reference, images, keys, **grid)
        names = ("rotation", "scale", "shear_x", "shear_y")
        table = F.array(F.struct(*names))
        size = images.join(best.select(*keys, *names), list(keys))
        return gather.affine(size, [*keys, *names], *(F.col(f"c_{n}") for n in names), by=[f"c_{n}" for n in names], candidates=F.transform(table, lambda s: F.struct(*(s[n].alias(f"c_{n}") for n in names)))).select(*keys, "y", "x", "v")
    raise ValueError(f"unknown registration {method}")


#: What the registration and the photometric fit that were asked for are called as sources of uncertainty.
REGISTRATION_SOURCES = {
    "none": "geometric_registration_not_applied",
    "global_similarity_grid_search": "global_similarity_registration",
    "global_affine_grid_search": "global_affine_registration",
    "integer_phase_correlation_translation": "global_translation_registration",
}
#: What a reference's record says of how it was made.
GENERATION = ("role", "source", "output", "method", "psf_model", "reference_resolution_m_per_px", "earth_moon_distance_m", "diffraction_sigma_reference_px")
FACTOR = "STRUCT<source: STRING, level: STRING, description: STRING, candidate_count: INT>"


def reference_row(record: dict | None, path: str) -> dict:
    """Of the references that a report lists the one with this output, or else the only one; empty if neither is there."""
    listed = (record or {}).get("references")
    rows = [r for r in listed if isinstance(r, dict)] if isinstance(listed, list) else []
    return next((r for r in rows if str(r.get("output")) == path), rows[0] if len(rows) == 1 else {})


def reference_metadata(record: dict | None, output: str, limitations: Sequence[str] = ()) -> dict:
    """What a report says of the reference that it was made against."""
    row, told = reference_row(record, output), (record or {}).get("limitations")
    return {
        "reference_limitations": [*limitations, *(map(str, told) if isinstance(told, list) else ())],
        "reference_provenance": row.get("label_provenance") or {},
        "reference_generation": {k: row[k] for k in GENERATION if k in row},
    }


def factor(source: Column | str, level: Column | str, description: str, candidates: int | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(source).alias("source"), text(level).alias("level"), F.lit(description).alias("description"), F.lit(candidates).cast("int").alias("candidate_count"))


def against_reference(reference: DataFrame, images: DataFrame, keys: Keys, registration: str = "none", photometry: str = "none", limitations: Sequence[str] = (), grid: dict | None = None, record: dict | None = None, output: str = "", **options) -> DataFrame:
    """As ``against_truth`` after registration and a photometric fit, with the uncertainty that both and the reference bring.

    ``record`` is the report that came with the reference, ``output`` the path it calls the reference by: what they do not tell is uncertain, too.
    """
    moved = registered(reference, images, keys, registration, **(grid or {}))
    applied = F.lit(False)
    if photometry == "linear_least_squares":
        fit = pixel.photometric_fit(pixel.paired(reference, moved, keys), keys)
        moved = pixel.photometric_apply(moved, fit, keys)
    elif photometry != "none":
        raise ValueError(f"unknown photometry {photometry}")
    rows = against_truth(reference, moved, keys, **options)
    if photometry != "none":
        rows = rows.join(fit.select(*keys, "is_applied", "scale", "offset"), list(keys))
        applied = F.col("is_applied")
    factors = []
    if record is not None:
        row = reference_row(record, output)
        told = record.get("limitations")
        limitations = [*limitations, *(map(str, told) if isinstance(told, list) else ())]
        if not row.get("label_provenance"):
            factors.append(factor("reference_provenance_missing", "medium", "nothing tells where the reference comes from"))
        if not any(k in row for k in GENERATION):
            factors.append(factor("reference_generation_missing", "medium", "nothing tells how the reference was made"))
        if not limitations:
            factors.append(factor("no_reference_limitations_reported", "low", "the reference's report names no limitation"))
    factors += [factor(x, rank.limitation_level(F.lit(x)), "a limitation that the reference's report declares") for x in limitations]
    candidates = None
    method = registration
    if registration == "grid":
        axes = {k: tuple((grid or {}).get(k, (0.0,))) for k in ("shears_x", "shears_y")}
        method = "global_affine_grid_search" if any(x != 0 for v in axes.values() for x in v) else "global_similarity_grid_search"
        candidates = math.prod(len(v) for v in {**axes, **{k: tuple(v) for k, v in (grid or {}).items()}}.values())
    factors.append(factor(REGISTRATION_SOURCES.get(method, f"registration_{method}"), rank.registration_level(F.lit(method)), "how the image was moved onto the reference", candidates))
    if photometry == "none":
        source: Column | str = "photometric_normalization_not_applied"
    else:
        source = F.when(applied, "global_linear_photometric_normalization").otherwise("photometric_normalization_skipped")
    factors.append(factor(source, rank.photometry_level(F.lit(photometry), applied), "how brightness was fitted to the reference"))
    rows = rows.withColumn("uncertainty", F.array(*factors).cast(f"ARRAY<{FACTOR}>"))
    worst = F.array_max(F.transform("uncertainty", lambda f: rank.level_rank(f["level"])))
    return rows.withColumn("risk_level", rank.level_name(worst))


def comparison(reports: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Ranked report rows and the leaders of each metric; two reports at least."""
    if reports.limit(2).count() < 2:
        raise ValueError("a comparison needs two reports at least")
    return rank.ranked(reports, "score", ordinal), rank.leaders(reports, ordinal)
