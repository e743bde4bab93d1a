"""Convolutions with reflected edges, and point-spread kernels.

Small kernels are broadcast tables of offsets joined to pixels; large ones run as one image a group in NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.operators.gather import sizes
from stillwater.operators.pixel import imploded

Keys = Sequence[str]
FIRST_ZERO = 3.8317059702075125  # of the Bessel function J1


def reflected(i: Column, n: Column) -> Column:
    """Index i folded into 0..n-1 about the first and the last pixel."""
    period = F.when(n > 1, 2 * (n - 1)).otherwise(1)
    m = F.pmod(i, period)
    return F.when(n > 1, F.least(m, period - m)).otherwise(0).cast("int")


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = max(1, math.ceil(4 * sigma))
    k = np.arange(-radius, radius + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    return w / w.sum()


def gaussian(image: DataFrame, keys: Keys, sigma: float) -> DataFrame:
    """Separable Gaussian blur, along x and then along y; sigma 0 leaves the image. Each pass sends a pixel's
    weighted value to the pixels it reaches, computed from the kernel array in the row."""
    if sigma == 0:
        return image
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    kernel = F.array(*(F.lit(float(w)) for w in weights))
    for axis, other, n in (("x", "y", "w"), ("y", "x", "h")):
        line = image.groupBy(*keys, other).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "v"))), lambda p: p["v"]).alias("line"))
        line = line.withColumn(n, F.size("line"))
        at = lambda i, k, n=n: F.element_at("line", (reflected(i + k - radius, F.col(n)) + 1).cast("int"))
        total = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * radius)), F.lit(0.0), lambda s, k: s + F.element_at(kernel, k + 1) * at(i, k)))
        image = line.select(*keys, other, F.posexplode(total).alias(axis, "v")).select(*keys, "y", "x", "v")
    return image


def nodes(count: int = 64) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(count)


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """By Gauss-Legendre quadrature of its integral over half a turn."""
    node, weight = nodes()
    theta = math.pi / 2 * (node + 1)
    return (weight / 2 * np.cos(theta - np.asarray(x, float)[..., None] * np.sin(theta))).sum(-1)


def bessel_column(x: Column) -> Column:
    """The same quadrature as an expression."""
    node, weight = nodes()
    theta = math.pi / 2 * (node + 1)
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w / 2)).alias("w")) for t, w in zip(theta, weight, strict=True)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * F.cos(p["t"] - x * F.sin(p["t"])))


def airy_kernel(spark: SparkSession, r0: float, obstruction: float = 0.0, truncate: float = 8.0) -> DataFrame:
    """oy, ox, weight: a diffraction pattern with its first zero at r0 pixels, clear or annular, adding up to 1."""
    radius = max(1, math.ceil(truncate * r0))
    offsets = spark.range(2 * radius + 1).select((F.col("id") - radius).cast("int").alias("oy")).withColumn("ox", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    arg = F.lit(FIRST_ZERO) * F.hypot("oy", "ox") / r0
    safe = F.when(F.col("arg") == 0, 1.0).otherwise(F.col("arg"))
    amplitude = 2 * bessel_column(safe) / safe
    if obstruction:
        amplitude = 2 * (bessel_column(safe) - obstruction * bessel_column(obstruction * safe)) / (safe * (1 - obstruction**2))
    rows = offsets.withColumn("arg", arg).withColumn("p", F.when(F.col("arg") == 0, 1.0).otherwise(F.pow(amplitude, F.lit(2.0))))
    return rows.select("oy", "ox", (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(1)))).alias("weight"))


def airy_array(r0: float, obstruction: float = 0.0, truncate: float = 8.0) -> np.ndarray:
    """The weights of ``airy_kernel`` as an array."""
    radius = max(1, math.ceil(truncate * r0))
    off = np.arange(-radius, radius + 1)
    arg = FIRST_ZERO * np.hypot(off[:, None], off[None]) / r0
    safe = np.where(arg == 0, 1.0, arg)
    amplitude = 2 * bessel_j1(safe) / safe
    if obstruction:
        amplitude = 2 * (bessel_j1(safe) - obstruction * bessel_j1(obstruction * safe)) / (safe * (1 - obstruction**2))
    pattern = np.where(arg == 0, 1.0, amplitude**2)
    return pattern / pattern.sum()


def convolved(image: DataFrame, kernel: DataFrame, keys: Keys) -> DataFrame:
    """Two-dimensional convolution by a kernel of few offsets (broadcast: a kernel's size is fixed by its radius)."""
    size = sizes(image, keys)
    asked = image.select(*keys, "y", "x").join(size, list(keys)).join(F.broadcast(kernel.withColumn("__one", F.lit(1))).hint("broadcast"), F.lit(True))
    asked = asked.select(*keys, F.col("y").alias("__y"), F.col("x").alias("__x"), "weight", reflected(F.col("y") + F.col("oy"), F.col("h")).alias("y"), reflected(F.col("x") + F.col("ox"), F.col("w")).alias("x"))
    got = asked.join(image.select(*keys, "y", "x", "v"), [*keys, "y", "x"])
    return got.groupBy(*keys, "__y", "__x").agg(F.sum(F.col("weight") * F.col("v")).alias("v")).withColumnsRenamed({"__y": "y", "__x": "x"})


def mirrored(n: int, radius: int) -> np.ndarray:
    """``reflected`` of all indices from -radius to n - 1 + radius."""
    period = max(1, 2 * (n - 1))
    m = np.arange(-radius, n + radius) % period
    return np.minimum(m, period - m) if n > 1 else np.zeros(len(m), int)


def convolve_stack(stack: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """As ``convolved``, of a stack (n, h, w) by a kernel array: an offset at a time."""
    (h, w), (ry, rx) = stack.shape[1:], (n // 2 for n in kernel.shape)
    padded = stack[:, mirrored(h, ry)[:, None], mirrored(w, rx)[None]]
    out = np.zeros(stack.shape)
    for y, x in np.ndindex(kernel.shape):
        out += kernel[y, x] * padded[:, y : y + h, x : x + w]
    return out


def convolve_array(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Dense route, by the Fourier transform of the reflected image; a kernel is symmetric here."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image, ((ry, ry), (rx, rx)), mode="reflect" if min(image.shape) > 1 else "edge")
    shape = [a + b - 1 for a, b in zip(padded.shape, kernel.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(padded, shape) * np.fft.rfft2(kernel, shape), shape)
    return full[2 * ry : 2 * ry + image.shape[0], 2 * rx : 2 * rx + image.shape[1]]


def dense_columns(image: DataFrame, keys: Keys, kernel, names: Sequence[str]) -> DataFrame:
    """keys, y, x, h, w and a column a name: ``kernel(array) -> {name: array}`` on each whole image, one image a row."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in image.select(*keys).schema), "h int", "w int", *(f"{n} array<double>" for n in names)])

    def run(batches):
        for part in batches:
            for row in part.itertuples(index=False):  # a large image is a batch of its own
                out = kernel(np.asarray(row.data, float).reshape(row.h, row.w))
                yield pd.DataFrame([(*(getattr(row, k) for k in keys), *out[names[0]].shape, *(out[n].ravel() for n in names))], columns=[*keys, "h", "w", *names])

    rows = imploded(image, keys).filter("h IS NOT NULL").mapInPandas(run, schema)  # no keys and no pixels are a row of nulls
    rows = rows.select(*keys, "h", "w", F.posexplode(F.arrays_zip(*names)).alias("p", "s"))
    return rows.select(*keys, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "h", "w", *(F.col("s")[n].alias(n) for n in names))


def dense(image: DataFrame, keys: Keys, kernel) -> DataFrame:
    """``kernel(array) -> array`` on each whole image, one image a row; images return as pixels."""
    return dense_columns(image, keys, lambda a: {"v": kernel(a)}, ["v"]).drop("h", "w")


def varying_blur(image: DataFrame, weight: DataFrame, keys: Keys, base: float, variation: float) -> DataFrame:
    """A blend of two Gaussians by a weight map (its ``v``); with the effective sigma. No variation is a plain blur."""
    if variation == 0:
        return gaussian(image, keys, base).withColumn("sigma", F.lit(base))
    low, high = max(0.0, base - variation), base + variation
    a = gaussian(image, keys, low).withColumnRenamed("v", "a")
    b = gaussian(image, keys, high).withColumnRenamed("v", "b")
    rows = a.join(b, [*keys, "y", "x"]).join(weight.withColumnRenamed("v", "m"), [*[k for k in keys if k in weight.columns], "y", "x"])
    return rows.select(*keys, "y", "x", ((1 - F.col("m")) * F.col("a") + F.col("m") * F.col("b")).alias("v"), F.sqrt((1 - F.col("m")) * low**2 + F.col("m") * high**2).alias("sigma"))
