"""Reference images as a telescope would see them, and regions of products made ready for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions import geometry
from stillwater.operators import convolve, datasets, gather, pixel

Keys = Sequence[str]


def telescope_reference(source: DataFrame, keys: Keys, sigma_px: float, dem: DataFrame | None = None, sun: Sequence[float] | None = None, observer: Sequence[float] | None = None, spacing: float = 100.0, model: str = "lambertian", projection: Sequence[float] | None = None, airy_r0: float | None = None, obstruction: float = 0.0) -> DataFrame:
    """A map shaded by its terrain, projected to the observer and blurred by the telescope, in that order.

    ``projection`` is the matrix (xe, xn, ye, yn); ``airy_r0`` chooses a diffraction kernel instead of a Gaussian.
    """
    image = pixel.checked(source)
    if dem is not None and sun is not None:
        lit = lambda v: tuple(F.lit(float(x)) for x in v)
        image = pixel.multiplied(image, geometry.shaded(pixel.checked(dem), [k for k in keys if k in dem.columns], spacing, lit(sun), lit(observer) if observer is not None else None, model), keys)
    if projection is not None:
        image = gather.inverse_sampled(image, keys, *(F.lit(float(x)) for x in projection), eps=1e-12)
    if airy_r0 is not None:
        kernel = convolve.airy_array(airy_r0, obstruction)  # thousands of offsets a pixel: by the Fourier transform, one image a row
        return convolve.dense(image, keys, lambda a: convolve.convolve_array(a, kernel))
    return convolve.gaussian(image, keys, sigma_px)


def chosen(references: DataFrame, role: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The first reference of a role, or the first of all."""
    rows = references if role is None else references.filter(F.col("role") == role)
    return rows.orderBy(ordinal).limit(1)


def extracted(files: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Files that can be cut out, and those that cannot with the reason."""
    rows = files.withColumn("reason", datasets.extraction_reason(columns))
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def reprojected(image: DataFrame, keys: Keys, width_km: float, height_km: float, m_per_px: float) -> DataFrame:
    """A cut-out on the region's own grid; missing pixels stay missing where nothing is known."""
    shape = [max(1, round(km * 1000.0 / m_per_px)) for km in (height_km, width_km)]
    return gather.resized_centres(image, keys, *shape)


def downloads(requirements: DataFrame, manifests: DataFrame) -> DataFrame:
    """What a region needs fetched: requirements (role, manifest) by manifest's product files, each destination once."""
    rows = requirements.join(manifests, "manifest").select("role", "manifest", F.inline("product_files"))
    from stillwater.operators import rank

    return rank.first_kept(rows, ["destination"], "role")
