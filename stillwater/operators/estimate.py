"""Estimators of displacement: phase correlation, block fields, grid-search registration; and the stacks built on them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.operators import arrays, gather, pixel

Keys = Sequence[str]


def hann(n: int) -> np.ndarray:
    return np.ones(n) if n <= 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def phase_shift(reference: np.ndarray, moving: np.ndarray) -> tuple[int, int]:
    """Whole-pixel displacement (u, v) of ``moving`` from ``reference``: the first peak of the whitened cross power's inverse."""
    window = np.outer(hann(reference.shape[0]), hann(reference.shape[1]))
    cross = np.fft.fft2((moving - moving.mean()) * window) * np.conj(np.fft.fft2((reference - reference.mean()) * window))
    size = np.abs(cross)
    white = np.divide(cross, size, out=np.zeros_like(cross), where=size > 0)
    y, x = np.unravel_index(int(np.argmax(np.fft.ifft2(white).real)), cross.shape)
    h, w = cross.shape
    return int(x - w if x > w // 2 else x), int(y - h if y > h // 2 else y)


def block_edges(n: int, block: int) -> list[tuple[int, int]]:
    """Blocks along an axis; one narrower than four pixels at the end becomes the last four."""
    out = []
    for i in range(math.ceil(n / block)):
        a, b = i * block, min(n, (i + 1) * block)
        out.append((max(0, n - 4), n) if b - a < 4 else (a, b))
    return out


def upsampled(coarse: np.ndarray, height: int, width: int) -> np.ndarray:
    """Align-corners bilinear resize of the first two axes."""

    def axis(a: np.ndarray, out: int) -> np.ndarray:
        at = np.linspace(0, len(a) - 1, out) if out > 1 else np.zeros(1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, len(a) - 1)
        f = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        return (1 - f) * a[low] + f * a[high]

    return np.swapaxes(axis(np.swapaxes(axis(coarse, height), 0, 1), width), 0, 1)


def block_field(reference: np.ndarray, moving: np.ndarray, block: int) -> np.ndarray:
    """A dense field (height, width, 2) from one phase correlation a block."""
    rows, cols = block_edges(reference.shape[0], block), block_edges(reference.shape[1], block)
    coarse = np.array([[phase_shift(reference[a:b, c:d], moving[a:b, c:d]) for c, d in cols] for a, b in rows], float)
    return upsampled(coarse, *reference.shape)


def dense_pairs(reference: DataFrame, moving: DataFrame, keys: Keys) -> DataFrame:
    """keys, h, w, data, ref: both images as arrays in a row."""
    shared = [k for k in keys if k in reference.columns]
    return pixel.imploded(moving, keys).join(pixel.imploded(reference, shared).select(*shared, F.col("data").alias("ref")), shared)


def typed(df: DataFrame, keys: Keys) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def shifts(reference: DataFrame, moving: DataFrame, keys: Keys) -> DataFrame:
    """keys, shift_u, shift_v by phase correlation."""

    def run(batches):
        for part in batches:
            got = [phase_shift(np.reshape(r.ref, (r.h, r.w)), np.reshape(r.data, (r.h, r.w))) for r in part.itertuples()]
            yield part[[*keys]].assign(shift_u=np.array([g[0] for g in got], "int32"), shift_v=np.array([g[1] for g in got], "int32"))

    return dense_pairs(reference, moving, keys).mapInPandas(run, f"{typed(moving, keys)}, shift_u int, shift_v int")


def block_fields(reference: DataFrame, moving: DataFrame, keys: Keys, block: int) -> DataFrame:
    """keys, y, x, u, w_v: dense fields from local phase correlations."""
    if block < 4:
        raise ValueError("a block has four pixels a side at least")

    def run(batches):
        for part in batches:
            rows = [(*(getattr(r, k) for k in keys), r.w, f[..., 0].ravel(), f[..., 1].ravel()) for r in part.itertuples() for f in [block_field(np.reshape(r.ref, (r.h, r.w)), np.reshape(r.data, (r.h, r.w)), block)]]
            yield pd.DataFrame(rows, columns=[*keys, "w", "us", "vs"])

    rows = dense_pairs(reference, moving, keys).mapInPandas(run, f"{typed(moving, keys)}, w int, us array<double>, vs array<double>")
    rows = rows.select(*keys, "w", F.posexplode(F.arrays_zip("us", "vs")).alias("p", "s"))
    return rows.select(*keys, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), F.col("s.us").alias("u"), F.col("s.vs").alias("w_v"))


def registration(reference: DataFrame, moving: DataFrame, keys: Keys, rotations: Sequence[float], scales: Sequence[float], shears_x: Sequence[float] = (0.0,), shears_y: Sequence[float] = (0.0,)) -> DataFrame:
    """The first candidate of least mean squared error for each image: keys, rotation, scale, shears, mse, ordinal, method."""
    grid = list(itertools.product(rotations, scales, shears_x, shears_y))
    names = ("rotation", "scale", "shear_x", "shear_y")
    table = F.array(*(F.struct(F.lit(i).alias("ordinal"), *(F.lit(float(x)).alias(n) for n, x in zip(names, c, strict=True))) for i, c in enumerate(grid)))
    by = ("ordinal", *names)
    turned = gather.affine(moving, keys, *(F.col(n) for n in names), by=by, candidates=table)
    error = pixel.paired(reference, turned, keys).groupBy(*keys, *by).agg(pixel.mse().alias("mse"))
    first = Window.partitionBy(*keys).orderBy("mse", "ordinal")
    method = "global_affine_grid_search" if any(s != 0 for s in (*shears_x, *shears_y)) else "global_similarity_grid_search"
    return error.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").withColumn("method", F.lit(method))


def registration_whole(reference: DataFrame, moving: DataFrame, keys: Keys, rotations: Sequence[float], scales: Sequence[float], shears_x: Sequence[float] = (0.0,), shears_y: Sequence[float] = (0.0,)) -> DataFrame:
    """As ``registration``, of images of one row each (``arrays.images``): a candidate at a time is made and compared."""
    grid = list(itertools.product(rotations, scales, shears_x, shears_y))

    def run(stack: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
        errors = np.stack([((gather.affine_stack(stack, *c) - ref) ** 2).mean((1, 2)) for c in grid], 1)
        first = np.where(np.isnan(errors), np.inf, errors).argmin(1)  # as in SQL, where NaN is the greatest
        return {"ordinal": first.astype("int32"), "mse": errors[np.arange(len(first)), first]}

    best = arrays.mapped(arrays.joined(reference, moving, keys), keys, run, sources=("data", "ref"), scalars="ordinal int, mse double")
    table = F.array(*(F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(("rotation", "scale", "shear_x", "shear_y"), c, strict=True))) for c in grid))
    method = "global_affine_grid_search" if any(s != 0 for s in (*shears_x, *shears_y)) else "global_similarity_grid_search"
    chosen = F.element_at(table, F.col("ordinal") + 1)
    return best.select(*keys, "ordinal", *(chosen[n].alias(n) for n in ("rotation", "scale", "shear_x", "shear_y")), "mse", F.lit(method).alias("method"))


def aligned_stack(frames: DataFrame, field: DataFrame, case: Keys, frame: str = "frame") -> DataFrame:
    """Mean of frames warped back by their fields, clipped."""
    back = field.withColumns({"u": -F.col("u"), "w_v": -F.col("w_v")})
    return pixel.clipped_stack(gather.warped(frames, back, [*case, frame]), case)


def first_frame(frames: DataFrame, case: Keys, frame: str = "frame") -> DataFrame:
    """Each case's first frame, without the frame column."""
    least = frames.groupBy(*case).agg(F.min(frame).alias(frame))
    return frames.join(least, [*case, frame], "left_semi").drop(frame)


def translation_stack(frames: DataFrame, case: Keys, frame: str = "frame") -> DataFrame:
    """Frames moved back onto the first by whole pixels, averaged and clipped."""
    moved = shifts(first_frame(frames, case, frame), frames, [*case, frame])
    field = frames.select(*case, frame, "y", "x").join(moved, [*case, frame]).select(*case, frame, "y", "x", F.col("shift_u").cast("double").alias("u"), F.col("shift_v").cast("double").alias("w_v"))
    return aligned_stack(frames, field, case, frame)


def block_stack(frames: DataFrame, case: Keys, block: int, frame: str = "frame") -> DataFrame:
    return aligned_stack(frames, block_fields(first_frame(frames, case, frame), frames, [*case, frame], block), case, frame)


def oracle_stack(frames: DataFrame, truth: DataFrame, case: Keys, frame: str = "frame") -> DataFrame:
    """With the true fields; frames and fields must be the same."""
    a, b = frames.select(*case, frame).distinct(), truth.select(*case, frame).distinct()
    lacking = a.join(b, [*case, frame], "left_anti").unionByName(b.join(a, [*case, frame], "left_anti"))
    if not lacking.isEmpty():
        raise ValueError("frames and true fields do not match")
    return aligned_stack(frames, truth, case, frame)
