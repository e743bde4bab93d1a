"""Operators that read pixels at other coordinates: sampling, resizing, warping, affine maps, block averages, crops."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.operators import arrays

Keys = Sequence[str]


def sizes(image: DataFrame, keys: Keys) -> DataFrame:
    return image.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))


def sampled(image: DataFrame, points: DataFrame, keys: Keys, h: str = "h", w: str = "w") -> DataFrame:
    """Bilinear samples at ``sy``, ``sx``, clipped to the edge; ``points`` has the keys, y, x and the image's size.

    Each point asks for its four corners by an equi join on pixels and adds their weighted values.
    """
    cy, cx = (F.greatest(F.least(F.col(s), (F.col(n) - 1).cast("double")), F.lit(0.0)) for s, n in (("sy", h), ("sx", w)))
    rows = points.withColumns({"__cy": cy, "__cx": cx}).withColumns({"__y0": F.floor("__cy").cast("int"), "__x0": F.floor("__cx").cast("int")})
    fy, fx = F.col("__cy") - F.col("__y0"), F.col("__cx") - F.col("__x0")
    y1, x1 = F.least(F.col("__y0") + 1, F.col(h) - 1), F.least(F.col("__x0") + 1, F.col(w) - 1)
    corner = lambda y, x, weight: F.struct(y.alias("y"), x.alias("x"), weight.alias("weight"))
    corners = F.array(corner(F.col("__y0"), F.col("__x0"), (1 - fy) * (1 - fx)), corner(F.col("__y0"), x1, (1 - fy) * fx), corner(y1, F.col("__x0"), fy * (1 - fx)), corner(y1, x1, fy * fx))
    extra = [c for c in points.columns if c not in ("sy", "sx", h, w)]
    asked = rows.select(*extra, F.explode(corners).alias("c")).select(*(F.col(c).alias(f"__o_{c}") if c in ("y", "x") else c for c in extra), F.col("c.y").alias("y"), F.col("c.x").alias("x"), "c.weight")
    shared = [k for k in keys if k in image.columns]
    got = asked.join(image.select(*shared, "y", "x", "v"), [*shared, "y", "x"])
    by = [f"__o_{c}" if c in ("y", "x") else c for c in extra]
    return got.groupBy(*by).agg(F.sum(F.col("weight") * F.col("v")).alias("v")).withColumnsRenamed({"__o_y": "y", "__o_x": "x"})


def grid(size: DataFrame, keys: Keys, h: Column | int, w: Column | int, *keep: str) -> DataFrame:
    """All pixels of grids of the given shape, one for each row of ``size``."""
    h, w = (F.lit(n) if isinstance(n, int) else n for n in (h, w))
    rows = size.select(*keys, *keep, F.explode(F.sequence(F.lit(0), h - 1)).alias("y"), w.alias("__w"))
    return rows.select(*keys, *keep, "y", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)).alias("x"))


def resized(image: DataFrame, keys: Keys, height: int, width: int) -> DataFrame:
    """Align-corners resize: the corners of both grids coincide; a single output pixel reads coordinate 0."""
    at = lambda i, n, out: (F.col(i) * (F.col(n) - 1) / float(out - 1)) if out > 1 else F.lit(0.0)
    points = grid(sizes(image, keys), keys, height, width, "h", "w").withColumns({"sy": at("y", "h", height).cast("double"), "sx": at("x", "w", width).cast("double")})
    return sampled(image, points, keys)


def resized_centres(image: DataFrame, keys: Keys, height: int, width: int) -> DataFrame:
    """Pixel-centre resize: missing (NaN) corners are left out and weights renormalised; NaN where all are missing."""
    points = grid(sizes(image, keys), keys, height, width, "h", "w")
    points = points.withColumns({"sy": (F.col("y") + 0.5) * F.col("h") / float(height) - 0.5, "sx": (F.col("x") + 0.5) * F.col("w") / float(width) - 0.5})
    points = points.withColumns({"y0": F.floor("sy"), "x0": F.floor("sx")}).withColumns({"fy": F.col("sy") - F.col("y0"), "fx": F.col("sx") - F.col("x0")})
    clip = lambda i, n: F.greatest(F.least(i, F.col(n) - 1), F.lit(0)).cast("int")
    corner = lambda dy, dx: F.struct(clip(F.col("y0") + dy, "h").alias("y"), clip(F.col("x0") + dx, "w").alias("x"), ((F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))).alias("weight"))
    asked = points.select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("c")).select(*keys, "__y", "__x", "c.*")
    got = asked.join(image.select(*keys, "y", "x", "v"), [*keys, "y", "x"])
    there = ~F.isnan("v")
    summed = got.groupBy(*keys, "__y", "__x").agg(F.sum(F.when(there, F.col("weight") * F.col("v")).otherwise(0.0)).alias("s"), F.sum(F.when(there, F.col("weight")).otherwise(0.0)).alias("n"))
    value = F.when(F.col("n") > 0, F.col("s") / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).otherwise(F.lit(float("nan")))
    return summed.select(*keys, F.col("__y").alias("y"), F.col("__x").alias("x"), value.alias("v"))


def constant_field(image: DataFrame, keys: Keys, u: float | Column, v: float | Column) -> DataFrame:
    """keys, y, x, u, du: the same displacement everywhere."""
    value = lambda c: F.lit(float(c)) if isinstance(c, (int, float)) else c
    return image.select(*keys, "y", "x", value(u).alias("u"), value(v).alias("w_v"))


def warped(image: DataFrame, field: DataFrame, keys: Keys) -> DataFrame:
    """Samples the image at (x - u, y - v); the field has u and w_v (its second component)."""
    points = field.join(sizes(image, keys), list(keys)).select(*keys, "y", "x", "h", "w", (F.col("y") - F.col("w_v")).alias("sy"), (F.col("x") - F.col("u")).alias("sx"))
    return sampled(image, points, keys)


def inverse_sampled(image: DataFrame, keys: Keys, a: Column, b: Column, c: Column, d: Column, by: Keys = (), candidates: Column | None = None, eps: float = 2.220446049250313e-16) -> DataFrame:
    """The image under the matrix [[a, b], [c, d]] on (x, y) about its centre, sampled inversely; a singular matrix raises.

    ``candidates`` (an array of structs) gives each image several matrices, told apart by the ``by`` fields.
    """
    size = sizes(image, keys)
    if candidates is not None:
        size = size.select("*", F.inline(candidates))
    det = a * d - b * c
    det = F.when(F.abs(det) > eps, det).otherwise(F.raise_error(F.lit("singular matrix")).cast("double"))
    size = size.select(*keys, *by, "h", "w", (d / det).alias("ia"), (-b / det).alias("ib"), (-c / det).alias("ic"), (a / det).alias("id"))
    rows = grid(size, [*keys, *by], F.col("h"), F.col("w"), "h", "w", "ia", "ib", "ic", "id")
    ox, oy = F.col("x") - (F.col("w") - 1) / 2.0, F.col("y") - (F.col("h") - 1) / 2.0
    points = rows.select(*keys, *by, "y", "x", "h", "w", (F.col("ic") * ox + F.col("id") * oy + (F.col("h") - 1) / 2.0).alias("sy"), (F.col("ia") * ox + F.col("ib") * oy + (F.col("w") - 1) / 2.0).alias("sx"))
    return sampled(image, points, keys)


def affine(image: DataFrame, keys: Keys, rotation: Column, scale: Column, shear_x: Column, shear_y: Column, by: Keys = (), candidates: Column | None = None) -> DataFrame:
    """Rotation (degrees), scale and shears about the centre."""
    cos, sin = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    return inverse_sampled(image, keys, scale * cos, -scale * sin + shear_x, scale * sin + shear_y, scale * cos, by, candidates)


def bilinear(stack: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> np.ndarray:
    """As ``sampled``, of a stack (n, h, w), all images at the same points."""
    h, w = stack.shape[1:]
    cy, cx = np.clip(sy, 0.0, h - 1.0), np.clip(sx, 0.0, w - 1.0)
    y0, x0 = np.floor(cy).astype(int), np.floor(cx).astype(int)
    fy, fx = cy - y0, cx - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    return (1 - fy) * ((1 - fx) * stack[:, y0, x0] + fx * stack[:, y0, x1]) + fy * ((1 - fx) * stack[:, y1, x0] + fx * stack[:, y1, x1])


def resized_stack(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """As ``resized``, of a stack."""
    sy, sx = (np.arange(out) * (n - 1) / (out - 1) if out > 1 else np.zeros(1) for n, out in zip(stack.shape[1:], (height, width), strict=True))
    return bilinear(stack, *np.meshgrid(sy, sx, indexing="ij"))


def resized_centres_stack(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """As ``resized_centres``, of a stack."""
    sy, sx = np.meshgrid(*((np.arange(out) + 0.5) * n / out - 0.5 for n, out in zip(stack.shape[1:], (height, width), strict=True)), indexing="ij")
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    total = norm = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            v = stack[:, np.clip(y0 + dy, 0, stack.shape[1] - 1), np.clip(x0 + dx, 0, stack.shape[2] - 1)]
            weight = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
            there = ~np.isnan(v)
            total = total + np.where(there, weight * v, 0.0)
            norm = norm + np.where(there, weight, 0.0)
    return np.divide(total, norm, out=np.full_like(total, np.nan), where=norm > 0)


def warped_stack(stack: np.ndarray, u: np.ndarray | float, v: np.ndarray | float) -> np.ndarray:
    """As ``warped``, of a stack by one field."""
    y, x = np.indices(stack.shape[1:])
    return bilinear(stack, y - v, x - u)


def affine_stack(stack: np.ndarray, rotation: float, scale: float, shear_x: float = 0.0, shear_y: float = 0.0, eps: float = 2.220446049250313e-16) -> np.ndarray:
    """As ``affine``, of a stack by one matrix."""
    cos, sin = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    a, b, c, d = scale * cos, -scale * sin + shear_x, scale * sin + shear_y, scale * cos
    det = a * d - b * c
    if not abs(det) > eps:
        raise ValueError("singular matrix")
    h, w = stack.shape[1:]
    y, x = np.indices((h, w))
    oy, ox = y - (h - 1) / 2.0, x - (w - 1) / 2.0
    return bilinear(stack, (-c / det) * ox + (a / det) * oy + (h - 1) / 2.0, (d / det) * ox + (-b / det) * oy + (w - 1) / 2.0)


def each(rows: DataFrame, keys: Keys, kernel) -> DataFrame:
    """Pixels of ``kernel(stack) -> stack`` over images of one row each (``arrays.images``)."""
    return arrays.pixels(arrays.mapped(rows, keys, lambda stack: {"v": kernel(stack)}), keys)


def block_average(image: DataFrame, keys: Keys, factor: int, values: Keys = ("v",), divide: float = 1.0) -> DataFrame:
    """Means of factor x factor blocks; displacements are divided by the factor as well. A size that is no multiple raises."""
    size = sizes(image, keys)
    bad = ((F.col("h") % factor) != 0) | ((F.col("w") % factor) != 0)
    fine = size.withColumn("ok", F.when(bad, F.raise_error(F.lit("size is no multiple of the factor")).cast("boolean")).otherwise(True)).filter("ok").select(*keys)
    rows = image.join(fine, list(keys), "left_semi") if keys else image
    return rows.groupBy(*keys, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(*((F.avg(c) / divide).alias(c) for c in values))


def cropped(image: DataFrame, top: Column | int, bottom: Column | int, left: Column | int, right: Column | int) -> DataFrame:
    """Rows top to bottom - 1 and columns left to right - 1: range predicates, which sources can push down."""
    return image.filter((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right))
