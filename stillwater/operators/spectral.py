"""Spectra, radial frequency curves, recovery limits and false detail.

A transform is two grouped sums over pixels (``dft``), rows without Python that grow with the cube of a side, or NumPy's FFT of one
image a row (``dft_dense``), which the evaluation of images of any size takes. Both give the same table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators import arrays, convolve
from stillwater.operators.gather import sizes

Keys = Sequence[str]


def dft(image: DataFrame, keys: Keys) -> DataFrame:
    """keys, ky, kx, re, im, h, w."""
    rows = image.join(sizes(image, keys), list(keys)) if keys else image.join(F.broadcast(sizes(image, keys)))
    rows = rows.select(*keys, "y", "x", "v", "h", "w", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("kx"))
    angle = F.lit(-2 * math.pi) * ((F.col("x") * F.col("kx")) % F.col("w")) / F.col("w")
    rows = rows.groupBy(*keys, "h", "w", "y", "kx").agg(F.sum(F.col("v") * F.cos(angle)).alias("a"), F.sum(F.col("v") * F.sin(angle)).alias("b"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("ky"))
    angle = F.lit(-2 * math.pi) * ((F.col("y") * F.col("ky")) % F.col("h")) / F.col("h")
    return rows.groupBy(*keys, "h", "w", "ky", "kx").agg(F.sum(F.col("a") * F.cos(angle) - F.col("b") * F.sin(angle)).alias("re"), F.sum(F.col("a") * F.sin(angle) + F.col("b") * F.cos(angle)).alias("im"))


def dft_dense(image: DataFrame, keys: Keys) -> DataFrame:
    """As ``dft``, by one FFT an image."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fft2(a)
        return {"re": f.real, "im": f.imag}

    return convolve.dense_columns(image, keys, run, ("re", "im")).withColumnsRenamed({"y": "ky", "x": "kx"}).select(*keys, "ky", "kx", "re", "im", "h", "w")


def inverse_dft(spectrum: DataFrame, keys: Keys) -> DataFrame:
    """keys, y, x, v: the real part of the inverse transform; missing frequencies count as 0."""
    rows = spectrum.select(*keys, "h", "w", "ky", "kx", "re", "im", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    angle = F.lit(2 * math.pi) * ((F.col("x") * F.col("kx")) % F.col("w")) / F.col("w")
    rows = rows.groupBy(*keys, "h", "w", "ky", "x").agg(F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("a"), F.sum(F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("b"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    angle = F.lit(2 * math.pi) * ((F.col("y") * F.col("ky")) % F.col("h")) / F.col("h")
    return rows.groupBy(*keys, "h", "w", "y", "x").agg(F.sum(F.col("a") * F.cos(angle) - F.col("b") * F.sin(angle)).alias("s")).select(*keys, "y", "x", (F.col("s") / (F.col("h") * F.col("w"))).alias("v"))


def signed(k: str, n: str) -> Column:
    """Frequency number k of n in cycles: the upper half is negative."""
    return F.when(F.col(k) < F.floor((F.col(n) + 1) / 2), F.col(k)).otherwise(F.col(k) - F.col(n))


def radius(ky: str = "ky", kx: str = "kx") -> Column:
    """Distance from zero frequency, 1 at Nyquist; exact for square images."""
    sy, sx = signed(ky, "h"), signed(kx, "w")
    square = F.sqrt((sy * sy + sx * sx).cast("double")) * 2 / F.col("h")
    return F.when(F.col("h") == F.col("w"), square).otherwise(F.hypot(sy / F.col("h"), sx / F.col("w")) * 2)


def half_plane() -> Column:
    """One of each pair of conjugate frequencies."""
    sy, sx = signed("ky", "h"), signed("kx", "w")
    return (sy > 0) | ((sy == 0) & (sx >= 0))


def agreement(cross: Column, a: Column, b: Column, same: Column) -> Column:
    """Normalised correlation; without energy on a side 1 for equal sides, else 0."""
    energy = a * b
    return F.when(energy > 0, cross / F.sqrt(F.when(energy > 0, energy).otherwise(1.0))).when(same, 1.0).otherwise(0.0)


def radial_curve(reference: DataFrame, other: DataFrame, keys: Keys, bins: int, transform=dft) -> DataFrame:
    """One row an image and bin of the normalised radius; the last bin is closed; bins without samples have null values and count 0.

    ``transform`` is ``dft`` or ``dft_dense``.
    """
    shared = [k for k in keys if k in reference.columns]
    pair = transform(other, keys).join(transform(reference, shared).select(*shared, "ky", "kx", F.col("re").alias("rr"), F.col("im").alias("ri")), [*shared, "ky", "kx"]).withColumn("r", radius())
    edges = np.linspace(0, 1, bins + 1)
    guess = F.least(F.floor(F.col("r") * bins), F.lit(bins - 1))
    edge = F.array(*(F.lit(float(e)) for e in edges))
    at = lambda i: F.element_at(edge, (i + 1).cast("int"))
    exact = F.when(F.col("r") < at(guess), guess - 1).when((guess < bins - 1) & (F.col("r") >= at(guess + 1)), guess + 1).otherwise(guess)
    rows = pair.filter(F.col("r") <= 1.0).withColumn("bin", exact.cast("int"))
    summed = rows.groupBy(*keys, "bin").agg(
        F.sum(F.col("rr") * F.col("re") + F.col("ri") * F.col("im")).alias("cross"),
        F.sum(F.col("rr") * F.col("rr") + F.col("ri") * F.col("ri")).alias("er"),
        F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("ev"),
        F.bool_and((F.col("rr") == F.col("re")) & (F.col("ri") == F.col("im"))).alias("same"),
        F.count_if(half_plane()).cast("int").alias("sample_count"),
        F.count(F.lit(1)).cast("int").alias("fourier_sample_count"),
    )
    every = other.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(summed, [*keys, "bin"], "left")
    phase = agreement(F.col("cross"), F.col("er"), F.col("ev"), F.col("same"))
    ratio = F.sqrt(F.col("ev") / F.when(F.col("er") > 0, F.col("er")).otherwise(1.0))
    amplitude = F.when((F.col("er") == 0) & (F.col("ev") == 0), 1.0).when((F.col("er") == 0) | (F.col("ev") == 0), 0.0).otherwise(F.least(ratio, 1 / F.when(ratio > 0, ratio).otherwise(1.0)))
    there = F.col("fourier_sample_count").isNotNull()
    out = out.withColumns({"phase_correlation": F.when(there, phase), "amplitude_recovery": F.when(there, amplitude)})
    return out.select(
        *keys, "bin", at(F.col("bin")).alias("frequency_min_fraction"), at(F.col("bin") + 1).alias("frequency_max_fraction"), ((at(F.col("bin")) + at(F.col("bin") + 1)) / 2).alias("frequency_mid_fraction"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"), F.coalesce("fourier_sample_count", F.lit(0)).alias("fourier_sample_count"),
        (F.col("phase_correlation") * F.col("amplitude_recovery")).alias("correlation"), "phase_correlation", "amplitude_recovery",
    )


def recovery_limit(curve: DataFrame, keys: Keys, threshold: float = 0.5) -> DataFrame:
    """The last midpoint of the first run of bins that pass; leading failures and empty bins are skipped; 0 if none passes."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = F.col("correlation").isNotNull() & ~F.isnan("correlation")
    rows = curve.withColumn("passes", good & (F.col("correlation") >= threshold)).withColumn("fails", good & ~F.col("passes"))
    rows = rows.withColumn("begun", F.max(F.col("passes").cast("int")).over(w)).withColumn("ended", F.max((F.col("fails") & (F.col("begun") == 1)).cast("int")).over(w))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("passes") & (F.col("ended") == 0), F.col("frequency_mid_fraction"))), F.lit(0.0)).alias("recovery_limit"))


def beyond_diffraction(curve: DataFrame, keys: Keys, fraction: float | None) -> DataFrame:
    """Mean correlation above the diffraction limit, of finite values; null if there are none."""
    over = F.lit(fraction).isNotNull() & (F.col("frequency_mid_fraction") > F.lit(fraction)) & ~F.isnan(F.coalesce("correlation", F.lit(float("nan"))))
    return curve.groupBy(*keys).agg(F.avg(F.when(over, F.col("correlation"))).alias("mean_correlation_beyond_diffraction"))


def high_pass(image: DataFrame, keys: Keys, cutoff: float = 0.6) -> DataFrame:
    """The image without frequencies below the cutoff; those in the corners, beyond 1, stay."""
    spectrum = dft(image, keys).withColumn("keep", (radius() >= cutoff).cast("double"))
    return inverse_dft(spectrum.withColumns({"re": F.col("re") * F.col("keep"), "im": F.col("im") * F.col("keep")}), keys)


def high_pass_array(image: np.ndarray, cutoff: float = 0.6) -> np.ndarray:
    """As ``high_pass``, of an image or a stack (n, h, w)."""
    h, w = image.shape[-2:]
    sy, sx = (np.where(np.arange(n) < (n + 1) // 2, np.arange(n), np.arange(n) - n) for n in (h, w))
    square = np.sqrt((sy[:, None] ** 2 + sx[None] ** 2).astype(float)) * 2 / h  # as ``radius``, so that both routes keep the same
    far = square if h == w else np.hypot(sy[:, None] / h, sx[None] / w) * 2
    return np.fft.ifft2(np.fft.fft2(image) * (far >= cutoff)).real


def high_pass_dense(image: DataFrame, keys: Keys, cutoff: float = 0.6) -> DataFrame:
    return convolve.dense(image, keys, lambda a: high_pass_array(a, cutoff))


def unsupported(multiplier: float = 1.5) -> Column:
    """Detail of the wrong sign, or much stronger than the reference's."""
    return (F.col("v") * F.col("r") < 0) | (F.abs("v") > multiplier * F.abs("r"))


def false_detail(high_pairs: DataFrame, keys: Keys, multiplier: float = 1.5) -> DataFrame:
    """Energies of unsupported detail over two high-passed images (r, v)."""
    rows = high_pairs.groupBy(*keys).agg(
        F.sum(F.when(unsupported(multiplier), F.col("v") * F.col("v")).otherwise(0.0)).alias("unsupported_energy"),
        F.sum(F.pow(F.col("v") - F.col("r"), F.lit(2.0))).alias("signed_residual_energy"),
        F.sum(F.col("v") * F.col("v")).alias("total_high_frequency_energy"),
    )
    total = F.col("total_high_frequency_energy")
    return rows.withColumn("unsupported_energy_fraction", F.when(total > 0, F.col("unsupported_energy") / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0))


def false_detail_map(high_pairs: DataFrame, keys: Keys, multiplier: float = 1.5) -> DataFrame:
    """Where the sign is wrong all of the detail, else what exceeds the supported amount."""
    value = F.when(F.col("v") * F.col("r") < 0, F.abs("v")).otherwise(F.greatest(F.abs("v") - multiplier * F.abs("r"), F.lit(0.0)))
    return high_pairs.select(*keys, "y", "x", value.alias("v"))


def high_joined(reference: DataFrame, rows: DataFrame, keys: Keys) -> DataFrame:
    """keys, h, w, data, ref: images of one row each beside the high-passed reference; they are high-passed where they are read."""
    shared = [k for k in keys if k in reference.columns]
    return arrays.joined(high_pass_dense(reference, shared), rows, keys)


def false_detail_whole(joined: DataFrame, keys: Keys, multiplier: float = 1.5) -> DataFrame:
    """As ``false_detail``, of images of one row each (``high_joined``)."""

    def run(stack: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
        v = high_pass_array(stack)
        bad = (v * r < 0) | (np.abs(v) > multiplier * np.abs(r)) | (np.isnan(v) & ~np.isnan(r))
        part, total = (a.sum((1, 2)) for a in (np.where(bad, v * v, 0.0), v * v))
        fraction = np.where(total <= 0, 0.0, part / np.where(total <= 0, 1.0, total))
        return {"unsupported_energy": part, "signed_residual_energy": ((v - r) ** 2).sum((1, 2)), "total_high_frequency_energy": total, "unsupported_energy_fraction": fraction}

    names = ("unsupported_energy", "signed_residual_energy", "total_high_frequency_energy", "unsupported_energy_fraction")
    return arrays.mapped(joined, keys, run, sources=("data", "ref"), scalars=", ".join(f"{n} double" for n in names))


def false_detail_map_whole(joined: DataFrame, keys: Keys, multiplier: float = 1.5) -> DataFrame:
    """As ``false_detail_map``, of images of one row each (``high_joined``)."""

    def run(stack: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
        v = high_pass_array(stack)
        return {"v": np.where(v * r < 0, np.abs(v), np.maximum(np.abs(v) - multiplier * np.abs(r), 0.0))}

    return arrays.pixels(arrays.mapped(joined, keys, run, sources=("data", "ref")), keys)
