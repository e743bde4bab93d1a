"""Angles, longitudes, directions, projection matrices and shading as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def longitude_within(lon: Column, west: Column, east: Column) -> Column:
    """Whether a longitude lies between two, eastwards from west; all already in 0 to 360."""
    return F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east))


def longitude_span(west: Column, east: Column) -> Column:
    return F.when(west <= east, east - west).otherwise(360.0 - west + east)


def longitude_offset(lon: Column, west: Column) -> Column:
    return F.pmod(lon - west, F.lit(360.0))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, k: Column) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def unit(a: Vector) -> Vector:
    return scaled(a, 1.0 / required(norm(a), "zero vector"))


def required(x: Column, what: str) -> Column:
    """The value, failing where it is not positive."""
    return F.when(x > 0, x).otherwise(F.raise_error(F.lit(what)).cast("double"))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors; a zero vector raises."""
    c = dot(a, b) / (required(norm(a), "zero vector") * required(norm(b), "zero vector"))
    return F.degrees(F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))


def surface(lat: Column, lon: Column) -> Vector:
    """Unit vector of degrees of latitude and longitude."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def latitude_longitude(a: Vector) -> tuple[Column, Column]:
    """Degrees of a vector, longitude in (-180, 180]."""
    return F.degrees(F.asin(a[2] / norm(a))), F.degrees(F.atan2(a[1], a[0]))


def geodetic(lat: Column, lon: Column, height: Column, equator: float, flattening: float) -> Vector:
    """Rectangular coordinates on a flattened body."""
    a, b = F.radians(lat), F.radians(lon)
    e2 = flattening * (2 - flattening)
    n = equator / F.sqrt(1 - e2 * F.sin(a) * F.sin(a))
    return (n + height) * F.cos(a) * F.cos(b), (n + height) * F.cos(a) * F.sin(b), (n * (1 - e2) + height) * F.sin(a)


def local_direction(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Vector:
    """East, north and up parts of the direction from a place to the point above which a body stands."""
    c, t, d = F.radians(lat), F.radians(to_lat), F.radians(to_lon - lon)
    return unit((F.cos(t) * F.sin(d), F.sin(t) * F.cos(c) - F.cos(t) * F.sin(c) * F.cos(d), F.sin(c) * F.sin(t) + F.cos(c) * F.cos(t) * F.cos(d)))


def projection(lat: Column, lon: Column, sub_lat: Column, sub_lon: Column) -> tuple[Column, Column, Column, Column, Column]:
    """The orthographic matrix (xe, xn, ye, yn) of east and north on the sky, and the cosine; the far side raises."""
    n, observer = surface(lat, lon), surface(sub_lat, sub_lon)
    zero = F.lit(0.0)
    east: Vector = (-F.sin(F.radians(lon)), F.cos(F.radians(lon)), zero)
    north = cross(n, east)
    cosine = dot(n, observer)
    e, p = (minus(v, scaled(observer, dot(v, observer))) for v in (east, north))
    sky_x = scaled(e, 1.0 / norm(e))
    q = minus(p, scaled(sky_x, dot(p, sky_x)))
    sky_y = scaled(q, 1.0 / norm(q))
    checked = F.when(cosine > 0, cosine).otherwise(F.raise_error(F.lit("surface point is not visible")).cast("double"))
    return dot(e, sky_x), dot(p, sky_x), dot(e, sky_y), dot(p, sky_y), checked


def illuminated(phase_degrees: Column) -> Column:
    return (1 + F.cos(F.radians(phase_degrees))) / 2


def central_gradient(image: DataFrame, keys, spacing: float) -> DataFrame:
    """dzdx and dzdy: central differences, one-sided at the edges."""

    def slope(by: list[str], along: str) -> Column:
        w = Window.partitionBy(*by).orderBy(along)
        after, before = F.lead("v").over(w), F.lag("v").over(w)
        return F.coalesce((after - before) / (2 * spacing), (after - F.col("v")) / spacing, (F.col("v") - before) / spacing, F.lit(0.0))

    return image.withColumn("dzdx", slope([*keys, "y"], "x")).withColumn("dzdy", slope([*keys, "x"], "y"))


def shaded(dem: DataFrame, keys, spacing: float, sun: Vector, observer: Vector | None = None, model: str = "lambertian") -> DataFrame:
    """Brightness of a height map under a sun direction (east, north, up), Lambertian or Lommel-Seeliger."""
    rows = central_gradient(dem, keys, spacing)
    size = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy") + 1)
    normal: Vector = (-F.col("dzdx") / size, -F.col("dzdy") / size, 1 / size)
    incidence = F.greatest(dot(normal, sun), F.lit(0.0))
    if model == "lambertian":
        value = incidence
    elif model == "lommel_seeliger":
        total = incidence + F.greatest(dot(normal, observer), F.lit(0.0))
        value = F.when(total > 0, 2 * incidence / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0)
    else:
        raise ValueError(f"unknown illumination model {model}")
    return rows.select(*keys, "y", "x", value.alias("v"))
