"""Telescope scalars as column expressions. Lengths: aperture and focal length in mm, wavelength in nm, pixels in um."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ARCSEC_PER_RADIAN = 206264.80624709636
FWHM_PER_SIGMA = 2.3548200450309493
MOON_MEAN_DISTANCE_M = 384_400_000.0


def guarded(top: Column, bottom: Column) -> Column:
    """A quotient, null where the divisor is 0 or missing."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def focal_ratio(aperture: Column, focal: Column) -> Column:
    return guarded(focal, aperture)


def plate_scale(focal: Column, pixel: Column) -> Column:
    """Arcseconds a pixel."""
    return guarded(F.lit(ARCSEC_PER_RADIAN) * pixel / 1000.0, focal)


def rayleigh(aperture: Column, wavelength: Column) -> Column:
    """First zero of the diffraction pattern, in arcseconds."""
    return guarded(F.lit(1.22 * ARCSEC_PER_RADIAN) * wavelength * 1e-6, aperture)


def airy_fwhm(aperture: Column, wavelength: Column) -> Column:
    return guarded(F.lit(1.028 * ARCSEC_PER_RADIAN) * wavelength * 1e-6, aperture)


def gaussian_sigma_px(aperture: Column, focal: Column, wavelength: Column, pixel: Column) -> Column:
    return guarded(airy_fwhm(aperture, wavelength), plate_scale(focal, pixel)) / FWHM_PER_SIGMA


def first_zero_px(aperture: Column, focal: Column, wavelength: Column, pixel: Column) -> Column:
    return guarded(rayleigh(aperture, wavelength), plate_scale(focal, pixel))


def obstructed_fraction(ratio: Column) -> Column:
    return ratio * ratio


def clear_area_mm2(aperture: Column, ratio: Column) -> Column:
    return F.pi() / 4 * aperture * aperture * (1 - ratio * ratio)


def moon_m_per_px(focal: Column, pixel: Column, distance: Column | float = MOON_MEAN_DISTANCE_M) -> Column:
    d = F.lit(distance) if isinstance(distance, float) else distance
    return d * plate_scale(focal, pixel) / ARCSEC_PER_RADIAN


def cutoff_of_nyquist(aperture: Column, focal: Column, wavelength: Column, pixel: Column) -> Column:
    """The diffraction cutoff D / (lambda f) as a part of the sensor's Nyquist frequency."""
    cutoff = guarded(aperture * 1e6, wavelength * focal)
    return cutoff * 2 * pixel / 1000.0


def reference_sigma_px(aperture: Column, focal: Column, wavelength: Column, pixel: Column, reference_m_per_px: Column, distance: Column | float = MOON_MEAN_DISTANCE_M) -> Column:
    return guarded(moon_m_per_px(focal, pixel, distance) * gaussian_sigma_px(aperture, focal, wavelength, pixel), reference_m_per_px)


def bundle(aperture: Column, focal: Column, wavelength: Column, pixel: Column, ratio: Column) -> list[Column]:
    """All of them, named."""
    return [
        focal_ratio(aperture, focal).alias("focal_ratio"),
        plate_scale(focal, pixel).alias("plate_scale_arcsec"),
        rayleigh(aperture, wavelength).alias("rayleigh_arcsec"),
        airy_fwhm(aperture, wavelength).alias("airy_fwhm_arcsec"),
        gaussian_sigma_px(aperture, focal, wavelength, pixel).alias("gaussian_sigma_px"),
        first_zero_px(aperture, focal, wavelength, pixel).alias("airy_first_zero_px"),
        obstructed_fraction(ratio).alias("obstruction_area_fraction"),
        clear_area_mm2(aperture, ratio).alias("clear_area_mm2"),
        moon_m_per_px(focal, pixel).alias("moon_m_per_px"),
        cutoff_of_nyquist(aperture, focal, wavelength, pixel).alias("cutoff_fraction_of_nyquist"),
    ]


def observation_reasons(aperture: Column, focal: Column, pixel: Column, wavelength: Column) -> Column:
    """What an observation lacks for a telescope, in a fixed order."""
    missing = (("telescope.aperture_mm", aperture), ("telescope.focal_length_mm", focal), ("camera.pixel_size_um", pixel), ("filter.effective_wavelength_nm", wavelength))
    return F.array_compact(F.array(*(F.when(c.isNull(), F.lit(f"missing_{name}")) for name, c in missing)))


def distance_with_reason(distance: Column) -> tuple[Column, Column]:
    """The distance, or the mean one and a tag that says so."""
    return F.coalesce(distance.cast("double"), F.lit(MOON_MEAN_DISTANCE_M)), F.when(distance.isNull(), F.array(F.lit("using_mean_earth_moon_distance"))).otherwise(F.array().cast("array<string>"))
