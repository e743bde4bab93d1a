"""Synthetic scenes and seeded simulation of frames seen through a turbulent atmosphere, with the truth retained."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.operators import convolve, estimate, pixel


def crater_image(spark: SparkSession, craters: DataFrame, height: int, width: int) -> DataFrame:
    """y, x, v in [0, 1] of a few craters (cx, cy, radius) on a sloping ground; a blank image raises."""
    ground = spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    listed = craters.agg(F.collect_list(F.struct("cx", "cy", "radius")).alias("all"))  # a scene's parameters: a few dozen rows
    rows = ground.join(F.broadcast(listed))
    x, y = F.col("x"), F.col("y")

    def one(c):
        d = F.hypot(x - c["cx"], y - c["cy"])
        rim = F.exp(-F.pow(d - c["radius"], F.lit(2.0)) / (2 * F.pow(0.12 * c["radius"], F.lit(2.0))))
        bowl = F.exp(-(d * d) / (2 * F.pow(0.62 * c["radius"], F.lit(2.0))))
        light = (-0.7 * (x - c["cx"]) - 0.3 * (y - c["cy"])) / F.greatest(c["radius"], F.lit(1.0))
        return 0.16 * rim - 0.12 * bowl + 0.035 * rim * F.greatest(F.least(light, F.lit(1.0)), F.lit(-1.0))

    base = 0.45 + 0.22 * x / float(max(width - 1, 1)) + 0.08 * F.sin(y / 11.0)
    rows = rows.withColumn("v", base + F.aggregate("all", F.lit(0.0), lambda s, c: s + one(c))).select("y", "x", "v")
    w = Window.partitionBy(F.lit(1))
    low, high = F.min("v").over(w), F.max("v").over(w)
    return rows.select("y", "x", F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(F.raise_error(F.lit("blank scene")).cast("double")).alias("v"))


def craters(rng: np.random.Generator, height: int, width: int, count: int = 48) -> pd.DataFrame:
    """Random craters, drawn in the order centre x, centre y, radius."""
    small, large = max(3.0, 0.015 * min(height, width)), max(4.0, 0.08 * min(height, width))
    return pd.DataFrame([(rng.uniform(0, width - 1), rng.uniform(0, height - 1), rng.uniform(small, large)) for _ in range(count)], columns=["cx", "cy", "radius"])


@dataclasses.dataclass(frozen=True)
class WarpScale:
    name: str
    amplitude_px: float
    correlation_px: float

    def validate(self) -> None:
        if self.amplitude_px < 0 or self.correlation_px <= 0:
            raise ValueError("a warp scale needs an amplitude of at least 0 and a positive correlation length")


#: The default scales.
SCALES = (WarpScale("large", 1.5, 64.0), WarpScale("medium", 0.7, 24.0), WarpScale("fine", 0.25, 8.0))


@dataclasses.dataclass(frozen=True)
class Simulation:
    """The settings of a simulated case. Unknown fields are refused by ``from_record``."""

    frame_count: int = 16
    random_seed: int = 0
    temporal_correlation: float = 0.85
    warp_scales: tuple[WarpScale, ...] = SCALES
    psf_sigma_px: float = 1.656
    seeing_blur_px: float = 2.0
    blur_variation_px: float = 0.0
    blur_correlation_px: float = 32.0
    global_motion_px: float = 0.75
    downsample: int = 1
    noise_sigma: float = 0.01
    low: float = 0.0
    high: float = 1.0

    def validate(self) -> None:
        for scale in self.warp_scales:
            scale.validate()
        if self.frame_count < 1 or self.downsample < 1:
            raise ValueError("frame_count and downsample are 1 at least")
        if not 0 <= self.temporal_correlation < 1:
            raise ValueError("temporal_correlation is in [0, 1)")
        if min(self.psf_sigma_px, self.seeing_blur_px, self.blur_variation_px, self.global_motion_px, self.noise_sigma) < 0 or self.blur_correlation_px <= 0:
            raise ValueError("blurs, motion and noise are 0 at least")
        if not self.low < self.high:
            raise ValueError("the sensor's range is empty")

    @classmethod
    def from_record(cls, record: dict) -> Simulation:
        unknown = sorted(set(record) - {f.name for f in dataclasses.fields(cls)})
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        scales = record.get("warp_scales")
        out = cls(**{**record, **({"warp_scales": tuple(WarpScale(**s) for s in scales)} if scales is not None else {})})
        out.validate()
        return out


def normalised(field: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation in each component."""
    spread = field.std(axis=(0, 1))
    return (field - field.mean(axis=(0, 1))) / np.where(spread == 0, 1.0, spread)


def warp_series(rng: np.random.Generator, scale: WarpScale, frames: int, rho: float, height: int, width: int) -> np.ndarray:
    """Fields (frames, height, width, 2) of one scale, autoregressive in time on a coarse grid."""
    shape = (max(2, math.ceil(height / scale.correlation_px) + 1), max(2, math.ceil(width / scale.correlation_px) + 1), 2)
    state, out = None, []
    for _ in range(frames):
        fresh = normalised(rng.normal(size=shape))
        state = fresh if state is None else normalised(rho * state + math.sqrt(1 - rho**2) * fresh)
        out.append(normalised(estimate.upsampled(state, height, width)) * scale.amplitude_px)
    return np.array(out)


def motion_series(rng: np.random.Generator, frames: int, rms: float, rho: float) -> np.ndarray:
    state, out = None, []
    for _ in range(frames):
        fresh = rng.normal(0.0, rms, 2)
        state = fresh if state is None else rho * state + math.sqrt(1 - rho**2) * fresh
        out.append(state)
    return np.array(out)


def sampled(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    h, w = image.shape
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = ys - y0, xs - x0
    return (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x1]) + fy * ((1 - fx) * image[y1, x0] + fx * image[y1, x1])


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    if sigma == 0:
        return image.copy()
    k = convolve.gaussian_weights(sigma)
    return convolve.convolve_array(image, np.outer(k, k))


def blocks(image: np.ndarray, factor: int) -> np.ndarray:
    h, w = image.shape[:2]
    if h % factor or w % factor:
        raise ValueError("size is no multiple of the factor")
    return image.reshape(h // factor, factor, w // factor, factor, *image.shape[2:]).mean(axis=(1, 3))


def simulate_case(image: np.ndarray, config: Simulation, seed: int) -> dict[str, np.ndarray]:
    """frames, latent (unblurred), warps and components. The stream is drawn scale by scale, then motion, then frame by frame."""
    config.validate()
    rng = np.random.default_rng(seed)
    h, w = image.shape
    parts = {s.name: warp_series(rng, s, config.frame_count, config.temporal_correlation, h, w) for s in config.warp_scales}
    if config.global_motion_px > 0:
        motion = motion_series(rng, config.frame_count, config.global_motion_px, config.temporal_correlation)
        parts["global"] = np.broadcast_to(motion[:, None, None, :], (config.frame_count, h, w, 2)).copy()
    field = sum(parts.values()) if parts else np.zeros((config.frame_count, h, w, 2))
    seen = blurred(image, config.psf_sigma_px)
    grid_y, grid_x = np.mgrid[:h, :w].astype(float)
    out = []
    for f in field:
        frame = sampled(seen, grid_y - f[..., 1], grid_x - f[..., 0])
        if config.blur_variation_px > 0:
            shape = tuple(max(2, math.ceil(n / config.blur_correlation_px) + 1) for n in (h, w))
            weight = estimate.upsampled(rng.uniform(size=shape), h, w)
            low, high = max(0.0, config.seeing_blur_px - config.blur_variation_px), config.seeing_blur_px + config.blur_variation_px
            frame = (1 - weight) * blurred(frame, low) + weight * blurred(frame, high)
        else:
            frame = blurred(frame, config.seeing_blur_px)
        frame = blocks(frame, config.downsample)
        if config.noise_sigma > 0:
            frame = frame + rng.normal(0.0, config.noise_sigma, frame.shape)
        out.append(np.clip(frame, config.low, config.high))
    small = lambda f: np.array([blocks(x, config.downsample) / config.downsample for x in f])
    return {"frames": np.array(out), "latent": blocks(image, config.downsample), "warps": small(field), **{f"component_{k}": small(v) for k, v in parts.items()}}


def simulate(images: DataFrame, keys: Sequence[str], config: Simulation) -> DataFrame:
    """keys, frame (from 1), y, x, v: one case an image, each from its own seed, one image a row in NumPy."""
    arrays = pixel.imploded(images, keys).withColumn("seed", F.pmod(F.xxhash64(*keys, F.lit(config.random_seed)), F.lit(1 << 31)))

    def run(batches):
        for part in batches:
            rows = []
            for row in part.itertuples(index=False):
                got = simulate_case(np.asarray(row.data, float).reshape(row.h, row.w), config, int(row.seed))
                rows += [(*(getattr(row, k) for k in keys), i + 1, f.shape[1], f.ravel()) for i, f in enumerate(got["frames"])]
            yield pd.DataFrame(rows, columns=[*keys, "frame", "w", "data"])

    rows = arrays.mapInPandas(run, f"{estimate.typed(images, keys)}, frame int, w int, data array<double>")
    return pixel.exploded(rows, [*keys, "frame"], "data", F.col("w"))
