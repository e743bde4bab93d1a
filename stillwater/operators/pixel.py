"""Per-pixel maps, contracts and metrics over long image tables.

An image table has key columns, ``y``, ``x`` (integers) and ``v`` (double). Every operator takes the key
columns, so that many images run in one plan; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def exploded(images: DataFrame, keys: Keys, data: str, width: int | Column) -> DataFrame:
    """Row-major arrays as pixels."""
    w = F.lit(width) if isinstance(width, int) else width
    rows = images.select(*keys, w.alias("__w"), F.posexplode(data).alias("__p", "__v"))
    return rows.select(*keys, F.floor(F.col("__p") / F.col("__w")).cast("int").alias("y"), (F.col("__p") % F.col("__w")).cast("int").alias("x"), F.col("__v").cast("double").alias("v"))


def imploded(image: DataFrame, keys: Keys) -> DataFrame:
    """Pixels as row-major arrays: keys, h, w, data."""
    rows = image.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("__p"))
    return rows.select(*keys, "h", "w", F.transform("__p", lambda p: p["v"]).alias("data"))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def checked(image: DataFrame) -> DataFrame:
    """The image, failing on the first pixel that is not finite."""
    return image.withColumn("v", F.when(finite(F.col("v")), F.col("v")).otherwise(F.raise_error(F.lit("image has a non-finite pixel")).cast("double")))


def contract(image: DataFrame, keys: Keys) -> DataFrame:
    """Per image: pixels, those not finite, and whether the grid is full."""
    return image.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.count_if(~finite(F.col("v"))).alias("n_bad"),
        (F.count(F.lit(1)) == (F.max("y") + 1).cast("long") * (F.max("x") + 1)).alias("is_full"),
    )


def paired(reference: DataFrame, other: DataFrame, keys: Keys) -> DataFrame:
    """keys, y, x, r, v: both images' values; keys that ``reference`` lacks are shared by all images."""
    shared = [k for k in keys if k in reference.columns]
    return other.join(reference.withColumnRenamed("v", "r"), [*shared, "y", "x"])


def pair_contract(reference: DataFrame, other: DataFrame, keys: Keys) -> DataFrame:
    """Per image: pixels of either side that the other lacks."""
    a, b = reference.withColumnRenamed("v", "r"), other
    both = a.join(b, [*keys, "y", "x"], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("v").isNull()).alias("n_only_reference"), F.count_if(F.col("r").isNull()).alias("n_only_other"))


def saturate(image: DataFrame, low: float, high: float) -> DataFrame:
    """Values clipped to the sensor's range, with flags of what lay strictly outside before."""
    return image.withColumns({"is_low": F.col("v") < low, "is_high": F.col("v") > high, "v": clipped(F.col("v"), low, high)})


def clipped(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def saturation(image: DataFrame, keys: Keys, low: float, high: float) -> DataFrame:
    return saturate(image, low, high).groupBy(*keys).agg(F.count_if("is_low").alias("n_low"), F.count_if("is_high").alias("n_high"), F.count(F.lit(1)).alias("n_pixels"))


def quantised(v: Column, levels: int = 65535) -> Column:
    """A unit value as it is after storage in an unsigned integer, ties to even."""
    return F.rint(v * levels) / levels


def display_scaled(image: DataFrame, keys: Keys) -> DataFrame:
    """Each image stretched to [0, 1], a constant one to 0; with its former extremes."""
    w = Window.partitionBy(*keys)
    rows = image.withColumns({"source_min": F.min("v").over(w), "source_max": F.max("v").over(w)})
    span = F.col("source_max") - F.col("source_min")
    return rows.withColumn("v", F.when(span == 0, 0.0).otherwise((F.col("v") - F.col("source_min")) / F.when(span == 0, 1.0).otherwise(span)))


def residual(reference: DataFrame, other: DataFrame, keys: Keys) -> DataFrame:
    return paired(reference, other, keys).withColumn("v", F.abs(F.col("v") - F.col("r"))).drop("r")


def gradient(image: DataFrame, keys: Keys, value: str = "v", out: str = "g") -> DataFrame:
    """Magnitude of forward differences; the last row and column repeat the difference before; an axis of one pixel has none."""

    def step(by: list[str], along: str) -> Column:
        w = Window.partitionBy(*by).orderBy(along)
        return F.coalesce(F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w), F.lit(0.0))

    return image.withColumn("__dx", step([*keys, "y"], "x")).withColumn("__dy", step([*keys, "x"], "y")).withColumn(out, F.hypot("__dx", "__dy")).drop("__dx", "__dy")


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; where a side is constant, 1 for equal sides and else 0."""
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).when(F.bool_and(F.col(a) == F.col(b)), 1.0).otherwise(0.0)


def mse(r: str = "r", v: str = "v") -> Column:
    return F.avg(F.pow(F.col(v) - F.col(r), F.lit(2.0)))


def psnr(error: Column, span: float = 1.0) -> Column:
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.lit(span * span) / F.when(error == 0, 1.0).otherwise(error)))


def ssim(r: str = "r", v: str = "v", span: float = 1.0) -> Column:
    """Structural similarity over the whole image, from population moments."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    mr, mv = F.avg(r), F.avg(v)
    return ((2 * mr * mv + c1) * (2 * F.covar_pop(r, v) + c2)) / ((mr * mr + mv * mv + c1) * (F.var_pop(r) + F.var_pop(v) + c2))


def similarity(pairs: DataFrame, keys: Keys, span: float = 1.0) -> DataFrame:
    """mse, psnr_db and ssim_global of each image in one aggregate."""
    return pairs.groupBy(*keys).agg(mse().alias("mse"), ssim(span=span).alias("ssim_global")).select(*keys, "mse", psnr(F.col("mse"), span).alias("psnr_db"), "ssim_global")


def gradient_correlation(pairs: DataFrame, keys: Keys) -> DataFrame:
    both = gradient(gradient(pairs, keys, "r", "gr"), keys, "v", "gv")
    return both.groupBy(*keys).agg(pearson("gr", "gv").alias("gradient_correlation"))


def edge_residual(pairs: DataFrame, keys: Keys) -> DataFrame:
    both = gradient(gradient(pairs, keys, "r", "gr"), keys, "v", "gv")
    return both.select(*keys, "y", "x", F.abs(F.col("gv") - F.col("gr")).alias("v"))


def metrics(pairs: DataFrame, keys: Keys, span: float = 1.0) -> DataFrame:
    """All pixel metrics of each image: one window pass, one aggregate."""
    both = gradient(gradient(pairs, keys, "r", "gr"), keys, "v", "gv")
    rows = both.groupBy(*keys).agg(mse().alias("mse"), ssim(span=span).alias("ssim_global"), pearson("gr", "gv").alias("gradient_correlation"))
    return rows.withColumn("psnr_db", psnr(F.col("mse"), span))


def mean_stack(frames: DataFrame, keys: Keys) -> DataFrame:
    """Mean over frames at each pixel, not clipped."""
    return frames.groupBy(*keys, "y", "x").agg(F.avg("v").alias("v"))


def clipped_stack(frames: DataFrame, keys: Keys) -> DataFrame:
    return mean_stack(frames, keys).withColumn("v", clipped(F.col("v")))


def photometric_fit(pairs: DataFrame, keys: Keys, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Least squares of the reference on the image: scale, offset, errors before and after; a flat image stays as it is."""
    rows = pairs.groupBy(*keys).agg(F.var_pop("v").alias("vv"), F.covar_pop("r", "v").alias("c"), F.avg("r").alias("mr"), F.avg("v").alias("mv"), F.var_pop("r").alias("vr"), mse().alias("mse_before"))
    flat = F.col("vv") <= eps
    scale = F.when(flat, 1.0).otherwise(F.col("c") / F.when(flat, 1.0).otherwise(F.col("vv")))
    rows = rows.withColumns({"is_applied": ~flat, "scale": scale}).withColumn("offset", F.when(flat, 0.0).otherwise(F.col("mr") - F.col("scale") * F.col("mv")))
    after = F.col("vr") + F.col("scale") * F.col("scale") * F.col("vv") - 2 * F.col("scale") * F.col("c")
    return rows.select(*keys, "is_applied", "scale", "offset", "mse_before", F.when(flat, F.col("mse_before")).otherwise(F.greatest(after, F.lit(0.0))).alias("mse_after"))


def photometric_apply(image: DataFrame, fit: DataFrame, keys: Keys) -> DataFrame:
    """scale * v + offset, not clipped."""
    return image.join(fit.select(*keys, "scale", "offset"), list(keys)).withColumn("v", F.col("scale") * F.col("v") + F.col("offset")).drop("scale", "offset")


def masked(image: DataFrame, constant: Column) -> DataFrame:
    """Missing constants as NaN; a constant that is no number masks nothing."""
    c = constant.try_cast("double")
    return image.withColumn("v", F.when(F.col("v") == c, F.lit(float("nan"))).otherwise(F.col("v")))


def multiplied(image: DataFrame, factor: DataFrame, keys: Keys) -> DataFrame:
    return paired(factor, image, keys).withColumn("v", F.col("v") * F.col("r")).drop("r")


def normalised_field(field: DataFrame, keys: Keys, columns: Keys = ("u", "v")) -> DataFrame:
    """Zero mean and unit population deviation per field and component; a constant component is only centred."""
    w = Window.partitionBy(*keys)
    for c in columns:
        spread = F.stddev_pop(c).over(w)
        field = field.withColumn(f"__{c}", (F.col(c) - F.avg(c).over(w)) / F.when(spread == 0, 1.0).otherwise(spread))
    return field.withColumns({c: F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def warp_error(truth: DataFrame, estimate: DataFrame, keys: Keys) -> DataFrame:
    """Length of the displacement error: mean, median, 95th percentile (linear), maximum, all exact."""
    by = [c for c in truth.columns if c not in ("u", "v")]
    both = truth.withColumnsRenamed({"u": "tu", "v": "tv"}).join(estimate, by)
    off = both.select(*keys, F.hypot(F.col("u") - F.col("tu"), F.col("v") - F.col("tv")).alias("e"))
    return off.groupBy(*keys).agg(F.avg("e").alias("mean_px"), F.percentile("e", F.lit(0.5)).alias("median_px"), F.percentile("e", F.lit(0.95)).alias("p95_px"), F.max("e").alias("max_px"))


def unmatched(truth: DataFrame, estimate: DataFrame, keys: Keys) -> DataFrame:
    """Keys of the truth that the estimate lacks."""
    return truth.select(*keys).distinct().join(estimate.select(*keys).distinct(), list(keys), "left_anti")
