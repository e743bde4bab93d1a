"""Queries over images: the vectors of ``embeddings`` as 8x8 frames, ``lineitem`` and ``events`` as rasters and series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.functions import geometry, telescope
from stillwater.operators import arrays, convolve, estimate, gather, pixel, rank, spectral

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PX = "px AS (SELECT vec_id, label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
STACK = "stack AS (SELECT label, y, x, avg(v) AS r FROM px GROUP BY ALL)"
PAIR = f"{PX}, {STACK}, pair AS (SELECT vec_id, label, y, x, v, r FROM px JOIN stack USING (label, y, x))"
IMAGE = ("vec_id", "label")


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    return F.round(c, digits) + F.lit(0.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.exploded(table(spark, sf_dir, "embeddings"), IMAGE, "embedding", 8)


def whole_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``frames``, one image a row; an image without an id is none, since the SQL joins pixels by it."""
    return arrays.images(table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL"), IMAGE, "embedding", 8)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame beside its label's mean stack."""
    px = frames(spark, sf_dir)
    return pixel.paired(pixel.mean_stack(px, ["label"]), px, IMAGE)


def rounded(df: DataFrame, *values: str, digits: int = 6) -> DataFrame:
    return df.select(*(r(c, digits).alias(c) if c in values else c for c in df.columns))


GRAD = """g AS (SELECT *, sqrt(power(coalesce(lead(v) OVER rx - v, v - lag(v) OVER rx, 0), 2) + power(coalesce(lead(v) OVER ry - v, v - lag(v) OVER ry, 0), 2)) AS gv,
 sqrt(power(coalesce(lead(r) OVER rx - r, r - lag(r) OVER rx, 0), 2) + power(coalesce(lead(r) OVER ry - r, r - lag(r) OVER ry, 0), 2)) AS gr
 FROM pair WINDOW rx AS (PARTITION BY vec_id, y ORDER BY x), ry AS (PARTITION BY vec_id, x ORDER BY y))"""
SSIM = "((2 * avg(r) * avg(v) + 0.0001) * (2 * covar_pop(r, v) + 0.0009)) / ((avg(r) * avg(r) + avg(v) * avg(v) + 0.0001) * (var_pop(r) + var_pop(v) + 0.0009))"
MSE = "avg((v - r) * (v - r))"
PEARSON = "CASE WHEN var_pop(gr) * var_pop(gv) > 0 THEN covar_pop(gr, gv) / sqrt(var_pop(gr) * var_pop(gv)) WHEN bool_and(gr = gv) THEN 1.0 ELSE 0.0 END"


@query(f"""WITH {PAIR}, {GRAD}, m AS (SELECT vec_id, label, {MSE} AS mse, {SSIM} AS s, {PEARSON} AS g FROM g GROUP BY ALL)
SELECT vec_id, label, round(mse, 6) + 0.0 AS mse, round(10 * log10(1 / mse), 4) + 0.0 AS psnr_db, round(s, 6) + 0.0 AS ssim_global, round(g, 6) + 0.0 AS gradient_correlation,
 CAST(row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, vec_id) AS INT) AS rank FROM m""")
def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every frame scored against its label's mean stack and ranked within the label."""
    m = pixel.metrics(pairs(spark, sf_dir), IMAGE)
    m = m.select(*IMAGE, r("mse").alias("mse"), r("psnr_db", 4).alias("psnr_db"), r("ssim_global").alias("ssim_global"), r("gradient_correlation").alias("gradient_correlation"))
    return rank.ranked(m, "ssim_global", "vec_id", ["label"])


@query(f"WITH {PX} SELECT label, y, x, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY ALL")
def mean_stack(spark, sf_dir):
    return rounded(pixel.mean_stack(frames(spark, sf_dir), ["label"]), "v")


@query(f"WITH {PX} SELECT label, y, x, round(greatest(least(avg(v), 1.0), 0.0), 6) + 0.0 AS v FROM px GROUP BY ALL")
def clip_stack(spark, sf_dir):
    return rounded(pixel.clipped_stack(frames(spark, sf_dir), ["label"]), "v")


@query(f"WITH {PAIR} SELECT vec_id, label, round({MSE}, 6) + 0.0 AS mse, round(10 * log10(1 / {MSE}), 4) + 0.0 AS psnr_db, round({SSIM}, 6) + 0.0 AS ssim_global FROM pair GROUP BY ALL")
def mse_psnr_ssim(spark, sf_dir):
    return rounded(rounded(pixel.similarity(pairs(spark, sf_dir), IMAGE), "mse", "ssim_global"), "psnr_db", digits=4)


@query(f"WITH {PAIR}, {GRAD} SELECT vec_id, label, round({PEARSON}, 6) + 0.0 AS gradient_correlation FROM g GROUP BY ALL")
def gradient_corr(spark, sf_dir):
    return rounded(pixel.gradient_correlation(pairs(spark, sf_dir), IMAGE), "gradient_correlation")


@query(f"WITH {PAIR} SELECT vec_id, label, y, x, round(abs(v - r), 6) + 0.0 AS v FROM pair")
def abs_residual(spark, sf_dir):
    px = frames(spark, sf_dir)
    return rounded(pixel.residual(pixel.mean_stack(px, ["label"]), px, IMAGE), "v").select(*IMAGE, "y", "x", "v")


@query(f"WITH {PAIR}, {GRAD} SELECT vec_id, label, y, x, round(abs(gv - gr), 6) + 0.0 AS v FROM g")
def edge_residual(spark, sf_dir):
    return rounded(pixel.edge_residual(pairs(spark, sf_dir), IMAGE), "v")


SCALED = f"{PX}, scaled AS (SELECT vec_id, label, y, x, min(v) OVER w AS lo, max(v) OVER w AS hi, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0.0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS v FROM px WINDOW w AS (PARTITION BY vec_id))"


@query(f"WITH {SCALED} SELECT vec_id, label, y, x, round(v, 6) + 0.0 AS v, round(lo, 6) + 0.0 AS source_min, round(hi, 6) + 0.0 AS source_max FROM scaled")
def minmax_scale(spark, sf_dir):
    return rounded(pixel.display_scaled(frames(spark, sf_dir), IMAGE), "v", "source_min", "source_max").select(*IMAGE, "y", "x", "v", "source_min", "source_max")


@query(f"WITH {SCALED} SELECT vec_id, y, x, CAST(round_even(v * 65535, 0) AS INT) AS sample, round(round_even(v * 65535, 0) / 65535, 6) + 0.0 AS v FROM scaled")
def quantise_u16(spark, sf_dir):
    px = pixel.display_scaled(frames(spark, sf_dir), IMAGE)
    return px.select("vec_id", "y", "x", F.rint(F.col("v") * 65535).cast("int").alias("sample"), r(pixel.quantised(F.col("v"))).alias("v"))


@query(f"WITH {PX} SELECT label, count(*) FILTER (v < -0.1) AS n_low, count(*) FILTER (v > 0.1) AS n_high, count(*) AS n_pixels FROM px GROUP BY label")
def sensor_saturation(spark, sf_dir):
    return pixel.saturation(frames(spark, sf_dir), ["label"], -0.1, 0.1)


@query(f"WITH {PX} SELECT vec_id, label, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY vec_id, label, y // 2, x // 2")
def block_downsample(spark, sf_dir):
    return rounded(gather.block_average(frames(spark, sf_dir), IMAGE, 2), "v")


@query(f"WITH {PX}, f AS (SELECT vec_id, y, x, 2 * v AS u, v - 1 AS w FROM px) SELECT vec_id, y // 4 AS y, x // 4 AS x, round(avg(u) / 4, 6) + 0.0 AS u, round(avg(w) / 4, 6) + 0.0 AS w_v FROM f GROUP BY vec_id, y // 4, x // 4")
def displacement_downsample(spark, sf_dir):
    field = frames(spark, sf_dir).select("vec_id", "y", "x", (2 * F.col("v")).alias("u"), (F.col("v") - 1).alias("w_v"))
    return rounded(gather.block_average(field, ["vec_id"], 4, ("u", "w_v"), 4.0), "u", "w_v")


def bilinear(points: str, keys: str = "vec_id", tail: str = "") -> str:
    """SQL that samples px at sy, sx of ``points`` (8x8, clipped to the edge)."""
    return f"""c AS (SELECT *, greatest(least(sy, 7.0), 0.0) AS cy, greatest(least(sx, 7.0), 0.0) AS cx FROM {points}),
 d AS (SELECT *, CAST(floor(cy) AS INT) AS y0, CAST(floor(cx) AS INT) AS x0, cy - floor(cy) AS fy, cx - floor(cx) AS fx FROM c),
 e AS (SELECT *, least(y0 + 1, 7) AS y1, least(x0 + 1, 7) AS x1 FROM d),
 s AS (SELECT e.*, (1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * p.v + fx * q.v) AS value FROM e
  JOIN px a ON a.vec_id = e.vec_id AND a.y = y0 AND a.x = x0 JOIN px b ON b.vec_id = e.vec_id AND b.y = y0 AND b.x = x1
  JOIN px p ON p.vec_id = e.vec_id AND p.y = y1 AND p.x = x0 JOIN px q ON q.vec_id = e.vec_id AND q.y = y1 AND q.x = x1){tail}"""


@query(f"WITH {PX}, ids AS (SELECT DISTINCT vec_id FROM px), pts AS (SELECT vec_id, CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, oy * 7 / 12.0 AS sy, ox * 7 / 10.0 AS sx FROM ids, (SELECT unnest(range(0, 13)) AS oy), (SELECT unnest(range(0, 11)) AS ox)), {bilinear('pts')} SELECT vec_id, oy AS y, ox AS x, round(value, 6) + 0.0 AS v FROM s")
def resize_align_corners(spark, sf_dir):
    return rounded(gather.each(whole_frames(spark, sf_dir), ["vec_id"], lambda a: gather.resized_stack(a, 13, 11)), "v")


@query(f"""WITH {PX}, ids AS (SELECT DISTINCT vec_id FROM px), pts AS (SELECT vec_id, CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, (oy + 0.5) * 8 / 5.0 - 0.5 AS sy, (ox + 0.5) * 8 / 6.0 - 0.5 AS sx FROM ids, (SELECT unnest(range(0, 5)) AS oy), (SELECT unnest(range(0, 6)) AS ox)),
 k AS (SELECT vec_id, oy, ox, floor(sy) + dy AS qy, floor(sx) + dx AS qx, (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS wt FROM pts, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)),
 j AS (SELECT k.vec_id, oy, ox, wt, v, (px.y * 8 + px.x) % 5 = 0 AS missing FROM k JOIN px ON px.vec_id = k.vec_id AND px.y = greatest(least(qy, 7), 0) AND px.x = greatest(least(qx, 7), 0))
SELECT vec_id, oy AS y, ox AS x, round(sum(CASE WHEN missing THEN 0 ELSE wt * v END) / nullif(sum(CASE WHEN missing THEN 0 ELSE wt END), 0), 6) + 0.0 AS v FROM j GROUP BY vec_id, oy, ox""")
def resize_pixel_centre(spark, sf_dir):
    def kernel(stack):
        missing = np.arange(stack[0].size).reshape(stack[0].shape) % 5 == 0
        return gather.resized_centres_stack(np.where(missing, np.nan, stack), 5, 6)

    out = gather.each(whole_frames(spark, sf_dir), ["vec_id"], kernel)
    return out.withColumn("v", F.when(~F.isnan("v"), r("v")))


@query(f"WITH {PX}, pts AS (SELECT vec_id, y AS oy, x AS ox, y + 0.75 AS sy, x - 1.5 AS sx FROM px), {bilinear('pts')} SELECT vec_id, oy AS y, ox AS x, round(value, 6) + 0.0 AS v FROM s")
def const_warp(spark, sf_dir):
    return rounded(gather.each(whole_frames(spark, sf_dir), ["vec_id"], lambda a: gather.warped_stack(a, 1.5, -0.75)), "v")


MATRIX = "a * d - b * c"


@query(f"""WITH {PX}, m AS (SELECT 1.1 * cos(radians(12.0)) AS a, -1.1 * sin(radians(12.0)) + 0.05 AS b, 1.1 * sin(radians(12.0)) - 0.02 AS c, 1.1 * cos(radians(12.0)) AS d),
 pts AS (SELECT vec_id, y AS oy, x AS ox, (-c / ({MATRIX})) * (x - 3.5) + (a / ({MATRIX})) * (y - 3.5) + 3.5 AS sy, (d / ({MATRIX})) * (x - 3.5) + (-b / ({MATRIX})) * (y - 3.5) + 3.5 AS sx FROM (SELECT vec_id, y, x FROM px), m), {bilinear('pts')} SELECT vec_id, oy AS y, ox AS x, round(value, 6) + 0.0 AS v FROM s""")
def affine_sample(spark, sf_dir):
    return rounded(gather.each(whole_frames(spark, sf_dir), ["vec_id"], lambda a: gather.affine_stack(a, 12.0, 1.1, 0.05, -0.02)), "v")


REFLECT = "least((({i}) % 14 + 14) % 14, 14 - (({i}) % 14 + 14) % 14)"


@query(f"""WITH {PX}, k AS (SELECT o, exp(-o * o / 2.0) / sum(exp(-o * o / 2.0)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o)),
 h AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS v FROM px a, k JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = {REFLECT.format(i='a.x + o')} GROUP BY ALL)
SELECT a.vec_id, a.y, a.x, round(sum(w * b.v), 6) + 0.0 AS v FROM h a, k JOIN h b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = {REFLECT.format(i='a.y + o')} GROUP BY a.vec_id, a.y, a.x""")
def gaussian_blur(spark, sf_dir):
    return rounded(convolve.gaussian(frames(spark, sf_dir).drop("label"), ["vec_id"], 1.0), "v")


AIRY = """t AS (SELECT (i + 0.5) * pi() / 64 AS t FROM (SELECT unnest(range(0, 64)) AS i)),
 o AS (SELECT oy, ox, 3.8317059702075125 * sqrt(oy * oy + ox * ox) / 2.0 AS a FROM (SELECT unnest(range(-6, 7)) AS oy), (SELECT unnest(range(-6, 7)) AS ox)),
 p AS (SELECT oy, ox, CASE WHEN a = 0 THEN 1.0 ELSE power(2 * (SELECT avg(cos(t - a * sin(t))) FROM t) / a, 2) END AS p FROM o)"""


@query(f"WITH {AIRY} SELECT CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, round(p / sum(p) OVER (), 6) + 0.0 AS weight FROM p")
def airy_kernel(spark, sf_dir):
    return rounded(convolve.airy_kernel(spark, 2.0, 0.0, 3.0), "weight")


def airy_blurred(rows: DataFrame) -> DataFrame:
    kernel = convolve.airy_array(2.0, 0.0, 3.0)
    return rounded(gather.each(rows, ["vec_id"], lambda a: convolve.convolve_stack(a, kernel)), "v")


@query(f"""WITH {PX}, {AIRY}, k AS (SELECT oy, ox, p / sum(p) OVER () AS w FROM p)
SELECT a.vec_id, a.y, a.x, round(sum(w * b.v), 6) + 0.0 AS v FROM px a, k JOIN px b ON b.vec_id = a.vec_id AND b.y = {REFLECT.format(i='a.y + oy')} AND b.x = {REFLECT.format(i='a.x + ox')} WHERE a.label < 3 GROUP BY a.vec_id, a.y, a.x""")
def airy_blur(spark, sf_dir):
    return airy_blurred(whole_frames(spark, sf_dir).filter("label < 3"))


@query(f"""WITH {PX}, {AIRY}, k AS (SELECT oy, ox, p / sum(p) OVER () AS w FROM p)
SELECT a.vec_id, a.y, a.x, round(sum(w * b.v), 6) + 0.0 AS v FROM px a, k JOIN px b ON b.vec_id = a.vec_id AND b.y = {REFLECT.format(i='a.y + oy')} AND b.x = {REFLECT.format(i='a.x + ox')} GROUP BY a.vec_id, a.y, a.x""")
def airy_blur_whole(spark, sf_dir):
    """As ``airy_blur``, of every image."""
    return airy_blurred(whole_frames(spark, sf_dir))


def dft_sql(name: str, source: str, keys: str, value: str) -> str:
    """CTEs of the transform of an 8x8 image table: name (keys, ky, kx, re, im)."""
    return f"""{name}1 AS (SELECT {keys}, y, kx, sum({value} * cos(-2 * pi() * ((x * kx) % 8) / 8)) AS a, sum({value} * sin(-2 * pi() * ((x * kx) % 8) / 8)) AS b FROM {source}, (SELECT unnest(range(0, 8)) AS kx) GROUP BY ALL),
 {name} AS (SELECT {keys}, ky, kx, sum(a * cos(-2 * pi() * ((y * ky) % 8) / 8) - b * sin(-2 * pi() * ((y * ky) % 8) / 8)) AS re, sum(a * sin(-2 * pi() * ((y * ky) % 8) / 8) + b * cos(-2 * pi() * ((y * ky) % 8) / 8)) AS im FROM {name}1, (SELECT unnest(range(0, 8)) AS ky) GROUP BY ALL)"""


SIGNED = "CASE WHEN {k} < 4 THEN {k} ELSE {k} - 8 END"
SY, SX = SIGNED.format(k="ky"), SIGNED.format(k="kx")
RADIUS = f"(sqrt(CAST(({SY}) * ({SY}) + ({SX}) * ({SX}) AS DOUBLE)) * 2 / 8)"


@query(f"WITH {PX}, {dft_sql('f', 'px', 'vec_id', 'v')} SELECT vec_id, CAST(ky AS INT) AS ky, CAST(kx AS INT) AS kx, round(re * re + im * im, 5) + 0.0 AS energy FROM f")
def dft_energy(spark, sf_dir):
    f = spectral.dft(frames(spark, sf_dir).drop("label"), ["vec_id"])
    return f.select("vec_id", "ky", "kx", r(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("energy"))


CURVE = f"""{PX}, {STACK}, {dft_sql('f', 'px', 'vec_id, label', 'v')}, {dft_sql('g', 'stack', 'label', 'r')},
 q AS (SELECT vec_id, label, ky, kx, f.re, f.im, g.re AS rr, g.im AS ri, {RADIUS} AS rad FROM f JOIN g USING (label, ky, kx)),
 b AS (SELECT vec_id, label, CAST(least(floor(rad * 4), 3) AS INT) AS bin, sum(rr * re + ri * im) AS cr, sum(rr * rr + ri * ri) AS er, sum(re * re + im * im) AS ev, CAST(count(*) FILTER (({SY}) > 0 OR (({SY}) = 0 AND ({SX}) >= 0)) AS INT) AS sample_count, CAST(count(*) AS INT) AS fourier_sample_count FROM q WHERE rad <= 1 GROUP BY ALL),
 curve AS (SELECT vec_id, label, bin, (bin + 0.5) / 4 AS mid, sample_count, fourier_sample_count, cr / sqrt(er * ev) AS phase, least(sqrt(ev / er), 1 / sqrt(ev / er)) AS amp FROM b)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames(spark, sf_dir)
    return spectral.radial_curve(pixel.mean_stack(px, ["label"]), px, IMAGE, 4)


@query(f"WITH {CURVE} SELECT vec_id, label, bin, round(mid, 6) AS frequency_mid_fraction, sample_count, fourier_sample_count, round(phase * amp, 5) + 0.0 AS correlation, round(phase, 5) + 0.0 AS phase_correlation, round(amp, 5) + 0.0 AS amplitude_recovery FROM curve")
def radial_curve(spark, sf_dir):
    c = curves(spark, sf_dir)
    return c.select(*IMAGE, "bin", F.round("frequency_mid_fraction", 6).alias("frequency_mid_fraction"), "sample_count", "fourier_sample_count", *(r(n, 5).alias(n) for n in ("correlation", "phase_correlation", "amplitude_recovery")))


@query(f"""WITH {CURVE}, p AS (SELECT vec_id, label, bin, mid, round(phase * amp, 5) >= 0.3 AS pass FROM curve),
 fp AS (SELECT vec_id, min(bin) FILTER (pass) AS first_pass FROM p GROUP BY vec_id),
 l AS (SELECT p.vec_id, min(bin) FILTER (NOT pass AND bin > first_pass) AS first_fail FROM p JOIN fp USING (vec_id) GROUP BY p.vec_id)
SELECT p.vec_id, label, coalesce(max(mid) FILTER (pass AND bin < coalesce(first_fail, 99)), 0.0) AS recovery_limit FROM p JOIN l USING (vec_id) GROUP BY p.vec_id, label""")
def recovery_limit(spark, sf_dir):
    c = curves(spark, sf_dir).withColumn("correlation", F.round("correlation", 5))
    return spectral.recovery_limit(c, IMAGE, 0.3)


def idft_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}1 AS (SELECT {keys}, ky, x, sum(re * cos(2 * pi() * ((x * kx) % 8) / 8) - im * sin(2 * pi() * ((x * kx) % 8) / 8)) AS a, sum(re * sin(2 * pi() * ((x * kx) % 8) / 8) + im * cos(2 * pi() * ((x * kx) % 8) / 8)) AS b FROM {source}, (SELECT unnest(range(0, 8)) AS x) GROUP BY ALL),
 {name} AS (SELECT {keys}, y, x, sum(a * cos(2 * pi() * ((y * ky) % 8) / 8) - b * sin(2 * pi() * ((y * ky) % 8) / 8)) / 64 AS v FROM {name}1, (SELECT unnest(range(0, 8)) AS y) GROUP BY ALL)"""


HIGH = f"""{PX}, {STACK}, {dft_sql('f', 'px', 'vec_id, label', 'v')}, {dft_sql('g', 'stack', 'label', 'r')}, fh AS (SELECT * FROM f WHERE {RADIUS} >= 0.6), gh AS (SELECT * FROM g WHERE {RADIUS} >= 0.6),
 {idft_sql('hv', 'fh', 'vec_id, label')}, {idft_sql('hr', 'gh', 'label')}, hp AS (SELECT vec_id, label, y, x, hv.v AS v, hr.v AS r FROM hv JOIN hr USING (label, y, x))"""


def high_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame, as an array, beside its label's high-passed mean stack."""
    return spectral.high_joined(pixel.mean_stack(frames(spark, sf_dir), ["label"]), whole_frames(spark, sf_dir), IMAGE)


@query(f"WITH {HIGH} SELECT vec_id, label, round(sum(CASE WHEN v * r < 0 OR abs(v) > 1.5 * abs(r) THEN v * v ELSE 0 END), 5) + 0.0 AS unsupported_energy, round(sum((v - r) * (v - r)), 5) + 0.0 AS signed_residual_energy, round(sum(v * v), 5) + 0.0 AS total_high_frequency_energy, round(sum(CASE WHEN v * r < 0 OR abs(v) > 1.5 * abs(r) THEN v * v ELSE 0 END) / sum(v * v), 5) + 0.0 AS unsupported_energy_fraction FROM hp GROUP BY vec_id, label")
def false_detail(spark, sf_dir):
    f = spectral.false_detail_whole(high_pairs(spark, sf_dir), IMAGE)
    return rounded(f, "unsupported_energy", "signed_residual_energy", "total_high_frequency_energy", "unsupported_energy_fraction", digits=5)


@query(f"WITH {HIGH} SELECT vec_id, label, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN v * r < 0 THEN abs(v) ELSE greatest(abs(v) - 1.5 * abs(r), 0.0) END, 5) + 0.0 AS v FROM hp")
def false_detail_map(spark, sf_dir):
    return rounded(spectral.false_detail_map_whole(high_pairs(spark, sf_dir), IMAGE), "v", digits=5)


def phase_sql(source: str, keys: str, n: int) -> str:
    """CTEs that end in shift (keys, u, w): phase correlation of the n x n images v and r of ``source`` (keys, y, x, v, r)."""
    turn = "2 * pi() * (({a} * {b}) % {n}) / {n}"
    tx, ty = turn.format(a="x", b="kx", n=n), turn.format(a="y", b="ky", n=n)
    ks, at = f"(SELECT unnest(range(0, {n})) AS k{{0}})", f"(SELECT unnest(range(0, {n})) AS {{0}})"
    rows = ", ".join(f"sum({c} * cos({tx})) AS {c}r, sum(-{c} * sin({tx})) AS {c}i" for c in "ab")
    both = ", ".join(f"sum({c}r * cos({ty}) + {c}i * sin({ty})) AS {c}r, sum({c}i * cos({ty}) - {c}r * sin({ty})) AS {c}i" for c in "ab")
    signed = "CAST(CASE WHEN {0} > {1} THEN {0} - {2} ELSE {0} END AS INT)"
    return f"""win AS (SELECT {keys}, y, x, (v - avg(v) OVER one) * hann AS a, (r - avg(r) OVER one) * hann AS b FROM (SELECT *, (0.5 - 0.5 * cos(2 * pi() * y / {n - 1})) * (0.5 - 0.5 * cos(2 * pi() * x / {n - 1})) AS hann FROM {source}) WINDOW one AS (PARTITION BY {keys})),
 rowwise AS (SELECT {keys}, y, kx, {rows} FROM win, {ks.format('x')} GROUP BY ALL),
 spectrum AS (SELECT {keys}, ky, kx, {both} FROM rowwise, {ks.format('y')} GROUP BY ALL),
 crossed AS (SELECT {keys}, ky, kx, ar * br + ai * bi AS re, ai * br - ar * bi AS im FROM spectrum),
 white AS (SELECT {keys}, ky, kx, coalesce(re / nullif(sqrt(re * re + im * im), 0), 0) AS re, coalesce(im / nullif(sqrt(re * re + im * im), 0), 0) AS im FROM crossed),
 back AS (SELECT {keys}, ky, x, sum(re * cos({tx}) - im * sin({tx})) AS re, sum(re * sin({tx}) + im * cos({tx})) AS im FROM white, {at.format('x')} GROUP BY ALL),
 peaks AS (SELECT {keys}, y, x, sum(re * cos({ty}) - im * sin({ty})) AS p FROM back, {at.format('y')} GROUP BY ALL),
 shift AS (SELECT {keys}, {signed.format('x', n // 2, n)} AS u, {signed.format('y', n // 2, n)} AS w FROM peaks QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(p, 9) DESC, y, x) = 1)"""


FIRST = f"{PX}, firsts AS (SELECT label, min(vec_id) AS vec_id FROM px GROUP BY label), pair AS (SELECT px.vec_id, px.label, px.y, px.x, px.v, f.v AS r FROM px JOIN firsts ON firsts.label = px.label JOIN px f ON f.vec_id = firsts.vec_id AND f.label = px.label AND f.y = px.y AND f.x = px.x)"
BLOCKS = f"blocks AS (SELECT vec_id, label, y // 4 AS v4, x // 4 AS h4, y % 4 AS y, x % 4 AS x, v, r FROM pair), {phase_sql('blocks', 'vec_id, label, v4, h4', 4)}"
FIELD = "field AS (SELECT vec_id, label, CAST(y AS INT) AS y, CAST(x AS INT) AS x, sum(wt * u) AS u, sum(wt * w) AS w_v FROM (SELECT shift.*, y, x, (CASE v4 WHEN 0 THEN 1 - y / 7.0 ELSE y / 7.0 END) * (CASE h4 WHEN 0 THEN 1 - x / 7.0 ELSE x / 7.0 END) AS wt FROM shift, (SELECT unnest(range(0, 8)) AS y), (SELECT unnest(range(0, 8)) AS x)) GROUP BY ALL)"
ALIGNED = "SELECT label, oy AS y, ox AS x, round(greatest(least(avg(value), 1.0), 0.0), 6) + 0.0 AS v FROM s GROUP BY label, oy, ox"


@query(f"WITH {PAIR}, {phase_sql('pair', 'vec_id, label', 8)} SELECT vec_id, label, u AS shift_u, w AS shift_v FROM shift")
def phase_shift(spark, sf_dir):
    px = frames(spark, sf_dir)
    return estimate.shifts(pixel.mean_stack(px, ["label"]), px, IMAGE)


@query(f"WITH {PAIR}, {BLOCKS}, {FIELD} SELECT vec_id, label, y, x, round(u, 6) + 0.0 AS u, round(w_v, 6) + 0.0 AS w_v FROM field")
def block_shift_field(spark, sf_dir):
    px = frames(spark, sf_dir)
    return rounded(estimate.block_fields(pixel.mean_stack(px, ["label"]), px, IMAGE, 4), "u", "w_v")


@query(f"""WITH {PAIR}, g AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS ordinal, rot, sc, sc * cos(radians(rot)) AS a, sc * sin(radians(rot)) AS c FROM (SELECT i, [-10.0, 0.0, 10.0][i] AS rot FROM (SELECT unnest([1, 2, 3]) AS i)), (SELECT j, [0.9, 1.0, 1.1][j] AS sc FROM (SELECT unnest([1, 2, 3]) AS j))),
 pts AS (SELECT vec_id, label, ordinal, rot, sc, y AS oy, x AS ox, (-c / (a * a + c * c)) * (x - 3.5) + (a / (a * a + c * c)) * (y - 3.5) + 3.5 AS sy, (a / (a * a + c * c)) * (x - 3.5) + (c / (a * a + c * c)) * (y - 3.5) + 3.5 AS sx FROM px, g), {bilinear('pts')},
 m AS (SELECT s.vec_id, s.label, ordinal, rot, sc, avg((value - r) * (value - r)) AS mse FROM s JOIN stack ON stack.label = s.label AND stack.y = oy AND stack.x = ox GROUP BY ALL)
SELECT vec_id, label, ordinal, rot AS rotation, sc AS scale, round(mse, 6) + 0.0 AS mse FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY mse, ordinal) = 1""")
def registration_grid(spark, sf_dir):
    stack = pixel.mean_stack(frames(spark, sf_dir), ["label"])
    best = estimate.registration_whole(stack, whole_frames(spark, sf_dir), IMAGE, (-10.0, 0.0, 10.0), (0.9, 1.0, 1.1))
    return best.select(*IMAGE, "ordinal", "rotation", "scale", r("mse").alias("mse"))


@query(f"WITH {PAIR} SELECT vec_id, label, true AS is_applied, round(covar_pop(r, v) / var_pop(v), 6) + 0.0 AS scale, round(avg(r) - covar_pop(r, v) / var_pop(v) * avg(v), 6) + 0.0 AS offset, round({MSE}, 6) + 0.0 AS mse_before, round(greatest(var_pop(r) - covar_pop(r, v) * covar_pop(r, v) / var_pop(v), 0.0), 6) + 0.0 AS mse_after FROM pair GROUP BY vec_id, label")
def photometric_fit(spark, sf_dir):
    return rounded(pixel.photometric_fit(pairs(spark, sf_dir), IMAGE), "scale", "offset", "mse_before", "mse_after")


@query(f"WITH {PAIR}, f AS (SELECT vec_id, covar_pop(r, v) / var_pop(v) AS s, avg(r) - covar_pop(r, v) / var_pop(v) * avg(v) AS o FROM pair GROUP BY vec_id) SELECT vec_id, label, y, x, round(s * v + o, 6) + 0.0 AS v FROM px JOIN f USING (vec_id)")
def photometric_apply(spark, sf_dir):
    fit = pixel.photometric_fit(pairs(spark, sf_dir), IMAGE)
    return rounded(pixel.photometric_apply(frames(spark, sf_dir), fit, IMAGE), "v").select(*IMAGE, "y", "x", "v")


FIELDS = f"{PAIR}, e AS (SELECT vec_id, label, CASE WHEN x < 4 THEN 'west' ELSE 'east' END AS component, sqrt(power(v - r, 2) + power(v + r - 2 * v * r - (v + r), 2)) AS e FROM pair)"


def fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True and estimated displacement fields made from pairs of images."""
    p = pairs(spark, sf_dir).withColumn("component", F.when(F.col("x") < 4, "west").otherwise("east"))
    keys = [*IMAGE, "component", "y", "x"]
    return p.select(*keys, F.col("r").alias("u"), (F.col("v") + F.col("r")).alias("v")), p.select(*keys, F.col("v").alias("u"), (F.col("v") + F.col("r") - 2 * F.col("v") * F.col("r")).alias("v"))


WARP_COLUMNS = "round(avg(e), 6) + 0.0 AS mean_px, round(quantile_cont(e, 0.5), 6) + 0.0 AS median_px, round(quantile_cont(e, 0.95), 6) + 0.0 AS p95_px, round(max(e), 6) + 0.0 AS max_px"


@query(f"WITH {FIELDS} SELECT vec_id, {WARP_COLUMNS} FROM e GROUP BY vec_id")
def warp_error(spark, sf_dir):
    return rounded(pixel.warp_error(*fields(spark, sf_dir), ["vec_id"]), "mean_px", "median_px", "p95_px", "max_px")


@query(f"WITH {FIELDS} SELECT label, component, {WARP_COLUMNS} FROM e GROUP BY label, component")
def warp_error_component(spark, sf_dir):
    return rounded(pixel.warp_error(*fields(spark, sf_dir), ["label", "component"]), "mean_px", "median_px", "p95_px", "max_px")


@query("SELECT label, component FROM (SELECT DISTINCT label, 'north' AS component FROM embeddings) WHERE label < 5")
def missing_components(spark, sf_dir):
    """Named components of the truth that the estimate lacks."""
    e = table(spark, sf_dir, "embeddings").select("label").distinct()
    truth = e.withColumn("component", F.explode(F.array(F.lit("north"), F.lit("south"))))
    have = e.withColumn("component", F.lit("south")).unionByName(e.filter("label >= 5").withColumn("component", F.lit("north")))
    return pixel.unmatched(truth, have, ["label", "component"])


@query(f"WITH {PX} SELECT vec_id, y, x, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 5) + 0.0 AS u FROM px WINDOW w AS (PARTITION BY vec_id)")
def rms_normalise(spark, sf_dir):
    f = frames(spark, sf_dir).select("vec_id", "y", "x", F.col("v").alias("u"))
    return rounded(pixel.normalised_field(f, ["vec_id"], ("u",)), "u", digits=5)


@query(f"WITH {PX} SELECT vec_id, label, count(*) AS n_pixels, CAST(0 AS BIGINT) AS n_bad, true AS is_full FROM px GROUP BY vec_id, label")
def image_contract(spark, sf_dir):
    return pixel.contract(frames(spark, sf_dir), IMAGE)


@query(f"WITH {PX} SELECT vec_id, label, count(*) FILTER (x = 7) AS n_only_reference, CAST(0 AS BIGINT) AS n_only_other FROM px GROUP BY vec_id, label")
def pair_contract(spark, sf_dir):
    px = frames(spark, sf_dir)
    return pixel.pair_contract(px, px.filter("x < 7"), IMAGE)


@query(f"WITH {PX}, m AS (SELECT vec_id, y, x, CASE WHEN round(v, 1) = 0.1 THEN NULL ELSE v END AS v FROM px) SELECT vec_id, count(v) AS n_valid, round(sum(v), 5) + 0.0 AS total FROM m GROUP BY vec_id")
def mask_constant(spark, sf_dir):
    px = frames(spark, sf_dir).withColumn("raw", F.col("v")).withColumn("v", F.round("v", 1))
    px = pixel.masked(px, F.lit("0.1"))
    return px.groupBy("vec_id").agg(F.count_if(~F.isnan("v")).alias("n_valid"), r(F.sum(F.when(~F.isnan("v"), F.col("raw"))), 5).alias("total"))


@query(f"WITH {PX}, {STACK} SELECT vec_id, px.label, y, x, round(v * r, 6) + 0.0 AS v FROM px JOIN stack USING (label, y, x)")
def shade_multiply(spark, sf_dir):
    px = frames(spark, sf_dir)
    return rounded(pixel.multiplied(px, pixel.mean_stack(px, ["label"]), IMAGE), "v").select(*IMAGE, "y", "x", "v")


@query(f"WITH {PX}, f AS (SELECT label, min(vec_id) AS vec_id FROM px GROUP BY label) SELECT px.label, y, x, round(v, 6) + 0.0 AS v FROM px JOIN f ON f.label = px.label AND f.vec_id = px.vec_id")
def first_frame(spark, sf_dir):
    return rounded(estimate.first_frame(frames(spark, sf_dir), ["label"], "vec_id"), "v").select("label", "y", "x", "v")


@query(f"WITH {PX}, fr AS (SELECT *, row_number() OVER (PARTITION BY label, y, x ORDER BY vec_id) AS frame FROM px) SELECT label, CAST(frame AS INT) AS frame, y, x, round(v, 6) + 0.0 AS v FROM fr WHERE frame = 3 AND y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def frame_crop(spark, sf_dir):
    """One frame of each case by its ordinal, cropped to a window."""
    e = table(spark, sf_dir, "embeddings").withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("int")).filter("frame = 3")
    return rounded(gather.cropped(pixel.exploded(e, ["label", "frame"], "embedding", 8), 2, 6, 1, 7), "v")


@query(f"""WITH {PX}, pts AS (SELECT vec_id, label, y AS oy, x AS ox, y + 0.5 * (vec_id % 3) AS sy, x - 0.25 * (vec_id % 2) AS sx FROM px), {bilinear('pts')}
SELECT label, oy AS y, ox AS x, round(greatest(least(avg(value), 1.0), 0.0), 6) + 0.0 AS v FROM s GROUP BY label, oy, ox""")
def oracle_stack(spark, sf_dir):
    """Frames warped back by their known fields, averaged and clipped."""
    px = frames(spark, sf_dir)
    truth = gather.constant_field(px, ["label", "vec_id"], -0.25 * (F.col("vec_id") % 2), 0.5 * (F.col("vec_id") % 3))
    return rounded(estimate.oracle_stack(px, truth, ["label"], "vec_id"), "v").select("label", "y", "x", "v")


@query(f"WITH {FIRST}, {phase_sql('pair', 'vec_id, label', 8)}, pts AS (SELECT vec_id, label, y AS oy, x AS ox, y + w AS sy, x + u AS sx FROM (SELECT vec_id, label, y, x FROM px) JOIN shift USING (vec_id, label)), {bilinear('pts')} {ALIGNED}")
def translation_stack(spark, sf_dir):
    return rounded(estimate.translation_stack(frames(spark, sf_dir), ["label"], "vec_id"), "v")


@query(f"WITH {FIRST}, {BLOCKS}, {FIELD}, pts AS (SELECT vec_id, label, y AS oy, x AS ox, y + w_v AS sy, x + u AS sx FROM field), {bilinear('pts')} {ALIGNED}")
def block_stack(spark, sf_dir):
    return rounded(estimate.block_stack(frames(spark, sf_dir), ["label"], 4, "vec_id"), "v")


@query(f"""WITH {PX}, k1 AS (SELECT o, exp(-o * o / 0.5) / sum(exp(-o * o / 0.5)) OVER () AS w FROM (SELECT unnest(range(-2, 3)) AS o)), k2 AS (SELECT o, exp(-o * o / 4.5) / sum(exp(-o * o / 4.5)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS o)),
 h1 AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS v FROM px a, k1 JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = {REFLECT.format(i='a.x + o')} GROUP BY ALL),
 g1 AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS v FROM h1 a, k1 JOIN h1 b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = {REFLECT.format(i='a.y + o')} GROUP BY ALL),
 h2 AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS v FROM px a, k2 JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = {REFLECT.format(i='a.x + o')} GROUP BY ALL),
 g2 AS (SELECT a.vec_id, a.y, a.x, sum(w * b.v) AS v FROM h2 a, k2 JOIN h2 b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = {REFLECT.format(i='a.y + o')} GROUP BY ALL)
SELECT vec_id, y, x, round((1 - (y + x) / 14.0) * g1.v + (y + x) / 14.0 * g2.v, 6) + 0.0 AS v, round(sqrt((1 - (y + x) / 14.0) * 0.25 + (y + x) / 14.0 * 2.25), 6) + 0.0 AS sigma FROM g1 JOIN g2 USING (vec_id, y, x)""")
def varying_blur(spark, sf_dir):
    px = frames(spark, sf_dir).drop("label")
    weight = px.select("vec_id", "y", "x", ((F.col("y") + F.col("x")) / 14.0).alias("v"))
    return rounded(convolve.varying_blur(px, weight, ["vec_id"], 1.0, 0.5), "v", "sigma")


@query("SELECT label, min_by(vec_id, vec_id) AS first_frame, round(min(s), 6) + 0.0 AS min_sigma, round(max(s), 6) + 0.0 AS max_sigma, count(*) AS n_frames FROM (SELECT label, vec_id, 1 + (vec_id % 7) / 10.0 AS s FROM embeddings) GROUP BY label")
def blur_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", (1 + (F.col("vec_id") % 7) / 10.0).alias("s"))
    return e.groupBy("label").agg(F.min_by("vec_id", "vec_id").alias("first_frame"), r(F.min("s")).alias("min_sigma"), r(F.max("s")).alias("max_sigma"), F.count(F.lit(1)).alias("n_frames"))


@query(f"WITH {PX}, c AS (SELECT vec_id, label, y, x, v AS u FROM px UNION ALL SELECT vec_id, label, y, x, -0.5 * v FROM px UNION ALL SELECT vec_id, label, y, x, 0.25 FROM px) SELECT vec_id, y, x, round(sum(u), 6) + 0.0 AS u FROM c GROUP BY vec_id, y, x")
def component_sum(spark, sf_dir):
    """Displacement components accumulated by position."""
    px = frames(spark, sf_dir)
    parts = [px.select("vec_id", "y", "x", c.alias("u")) for c in (F.col("v"), -0.5 * F.col("v"), F.lit(0.25))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("vec_id", "y", "x").agg(F.sum("u").alias("u")), "u")


RASTER = "raster AS (SELECT CAST(least(floor(l_quantity), 49) AS INT) AS y, CAST(floor(l_discount * 100 + 0.5) AS INT) AS x, avg(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY 1, 2)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` binned to a grid: quantity by discount, mean price."""
    rows = table(spark, sf_dir, "lineitem").select(F.least(F.floor("l_quantity"), F.lit(49)).cast("int").alias("y"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("x"), "l_extendedprice")
    return rows.groupBy("y", "x").agg((F.avg("l_extendedprice") / 1000).alias("v"))


@query("SELECT CAST(least(floor(l_quantity), 49) AS INT) AS y, CAST(floor(l_discount * 100 + 0.5) AS INT) AS x, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem GROUP BY 1, 2")
def lineitem_raster(spark, sf_dir):
    """The raster's sums, in whole cents: means of prices end in ties that engines round differently."""
    rows = table(spark, sf_dir, "lineitem").select(F.least(F.floor("l_quantity"), F.lit(49)).cast("int").alias("y"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return rows.groupBy("y", "x").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))


SLOPE = f"""{RASTER}, z AS (SELECT y, x, coalesce((lead(v) OVER rx - lag(v) OVER rx) / 20.0, (lead(v) OVER rx - v) / 10.0, (v - lag(v) OVER rx) / 10.0, 0.0) AS zx, coalesce((lead(v) OVER ry - lag(v) OVER ry) / 20.0, (lead(v) OVER ry - v) / 10.0, (v - lag(v) OVER ry) / 10.0, 0.0) AS zy FROM raster WINDOW rx AS (PARTITION BY y ORDER BY x), ry AS (PARTITION BY x ORDER BY y)),
 lit AS (SELECT y, x, greatest((-zx * 0.6 - zy * 0.0 + 0.8) / sqrt(zx * zx + zy * zy + 1), 0.0) AS inc, greatest((-zx * 0.0 - zy * 0.6 + 0.8) / sqrt(zx * zx + zy * zy + 1), 0.0) AS emi FROM z)"""
SUN = (F.lit, (0.6, 0.0, 0.8))


@query(f"WITH {SLOPE} SELECT y, x, round(inc, 5) + 0.0 AS v FROM lit")
def dem_shading(spark, sf_dir):
    return rounded(geometry.shaded(raster(spark, sf_dir), [], 10.0, tuple(map(F.lit, (0.6, 0.0, 0.8)))), "v", digits=5)


@query(f"WITH {SLOPE} SELECT y, x, round(CASE WHEN inc + emi > 0 THEN 2 * inc / (inc + emi) ELSE 0 END, 5) + 0.0 AS v FROM lit")
def lommel_seeliger(spark, sf_dir):
    return rounded(geometry.shaded(raster(spark, sf_dir), [], 10.0, tuple(map(F.lit, (0.6, 0.0, 0.8))), tuple(map(F.lit, (0.0, 0.6, 0.8))), "lommel_seeliger"), "v", digits=5)


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS f, (p_partkey % 5) / 10e0 AS o FROM part)
SELECT p_partkey, round(f / a, 6) AS focal_ratio, round(206264.80624709636e0 * 2.9e0 / 1000 / f, 6) AS plate_scale_arcsec, round(1.22e0 * 206264.80624709636e0 * 550 * 1e-6 / a, 6) AS rayleigh_arcsec, round(1.028e0 * 206264.80624709636e0 * 550 * 1e-6 / a, 6) AS airy_fwhm_arcsec,
 round((1.028e0 * 206264.80624709636e0 * 550 * 1e-6 / a) / (206264.80624709636e0 * 2.9e0 / 1000 / f) / 2.3548200450309493e0, 5) AS gaussian_sigma_px, round((1.22e0 * 206264.80624709636e0 * 550 * 1e-6 / a) / (206264.80624709636e0 * 2.9e0 / 1000 / f), 5) AS airy_first_zero_px,
 round(o * o, 6) AS obstruction_area_fraction, round(pi() / 4 * a * a * (1 - o * o), 4) AS clear_area_mm2, round(384400000e0 * 2.9e0 / 1000 / f, 3) AS moon_m_per_px, round(a * 1e6 / (550 * f) * 2 * 2.9e0 / 1000, 6) AS cutoff_fraction_of_nyquist FROM p WHERE a > 0 AND f > 0""")
def telescope_derived(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("f"), ((F.col("p_partkey") % 5) / 10.0).alias("o")).filter("a > 0 AND f > 0")
    rows = p.select("p_partkey", *telescope.bundle(F.col("a"), F.col("f"), F.lit(550.0), F.lit(2.9), F.col("o")))
    digits = {"gaussian_sigma_px": 5, "airy_first_zero_px": 5, "clear_area_mm2": 4, "moon_m_per_px": 3}
    return rows.select("p_partkey", *(F.round(c, digits.get(c, 6)).alias(c) for c in rows.columns[1:]))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, CAST(max(c) AS BIGINT) AS n_events, round(sum(power(0.85, c - n) * CASE WHEN n = 1 THEN 1.0 ELSE sqrt(1 - 0.85 * 0.85) END * value), 5) + 0.0 AS state FROM e GROUP BY user_id""")
def ar1_series(spark, sf_dir):
    """Each user's autoregressive state after its last event: s = rho s + sqrt(1 - rho^2) value, folded in order."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    start = F.struct(F.lit(True).alias("first"), F.lit(0.0).alias("s"))
    fold = F.aggregate("a", start, lambda z, x: F.struct(F.lit(False).alias("first"), F.when(z["first"], x["value"]).otherwise(0.85 * z["s"] + (1 - 0.85**2) ** 0.5 * x["value"]).alias("s")))
    return e.select("user_id", "n_events", r(fold["s"], 5).alias("state"))


@query("SELECT event_type, count(*) FILTER (value < 10) AS n_low, count(*) FILTER (value > 90) AS n_high, round(avg(greatest(least(value, 90.0), 10.0)), 5) + 0.0 AS mean_clipped FROM events GROUP BY event_type")
def saturation_by_type(spark, sf_dir):
    e = pixel.saturate(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("v")), 10.0, 90.0)
    return e.groupBy("event_type").agg(F.count_if("is_low").alias("n_low"), F.count_if("is_high").alias("n_high"), r(F.avg("v"), 5).alias("mean_clipped"))


@query("""WITH c AS (SELECT s_suppkey AS id, 31.0 * ((s_suppkey * 37) % 100) / 100 AS cx, 31.0 * ((s_suppkey * 53) % 100) / 100 AS cy, 3.0 + (s_suppkey % 4) AS rad FROM supplier WHERE s_suppkey <= 10),
 g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(0, 32)) AS y), (SELECT unnest(range(0, 32)) AS x)),
 t AS (SELECT y, x, 0.45 + 0.22 * x / 31.0 + 0.08 * sin(y / 11.0) + sum(0.16 * exp(-power(sqrt(power(x - cx, 2) + power(y - cy, 2)) - rad, 2) / (2 * power(0.12 * rad, 2))) - 0.12 * exp(-(power(x - cx, 2) + power(y - cy, 2)) / (2 * power(0.62 * rad, 2)))
  + 0.035 * exp(-power(sqrt(power(x - cx, 2) + power(y - cy, 2)) - rad, 2) / (2 * power(0.12 * rad, 2))) * greatest(least((-0.7 * (x - cx) - 0.3 * (y - cy)) / greatest(rad, 1.0), 1.0), -1.0)) AS v FROM g, c GROUP BY y, x)
SELECT y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 5) + 0.0 AS v FROM t""")
def crater_field(spark, sf_dir):
    from stillwater.sources import synthetic

    s = F.col("s_suppkey")
    craters = table(spark, sf_dir, "supplier").filter("s_suppkey <= 10").select((31.0 * ((s * 37) % 100) / 100).alias("cx"), (31.0 * ((s * 53) % 100) / 100).alias("cy"), (3.0 + s % 4).alias("radius"))
    return rounded(synthetic.crater_image(spark, craters, 32, 32), "v", digits=5)


@query("""WITH c AS (SELECT s_suppkey AS id, 31.0 * ((s_suppkey * 37) % 100) / 100 AS cx, 31.0 * ((s_suppkey * 53) % 100) / 100 AS cy, 3.0 + (s_suppkey % 4) AS rad FROM supplier),
 g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range(0, 32)) AS y), (SELECT unnest(range(0, 32)) AS x)),
 t AS (SELECT y, x, 0.45 + 0.22 * x / 31.0 + 0.08 * sin(y / 11.0) + sum(0.16 * exp(-power(sqrt(power(x - cx, 2) + power(y - cy, 2)) - rad, 2) / (2 * power(0.12 * rad, 2))) - 0.12 * exp(-(power(x - cx, 2) + power(y - cy, 2)) / (2 * power(0.62 * rad, 2)))
  + 0.035 * exp(-power(sqrt(power(x - cx, 2) + power(y - cy, 2)) - rad, 2) / (2 * power(0.12 * rad, 2))) * greatest(least((-0.7 * (x - cx) - 0.3 * (y - cy)) / greatest(rad, 1.0), 1.0), -1.0)) AS v FROM g, c GROUP BY y, x)
SELECT y, x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 5) + 0.0 AS v FROM t""")
def crater_field_whole(spark, sf_dir):
    """As ``crater_field``, with every supplier as a crater."""
    from stillwater.sources import synthetic

    s = F.col("s_suppkey")
    craters = table(spark, sf_dir, "supplier").select((31.0 * ((s * 37) % 100) / 100).alias("cx"), (31.0 * ((s * 53) % 100) / 100).alias("cy"), (3.0 + s % 4).alias("radius"))
    return rounded(synthetic.crater_image(spark, craters, 32, 32), "v", digits=5)


@query()
def simulated_frames(spark, sf_dir):
    """Seeded simulation of one case a label: degraded frames of its mean stack, enlarged."""
    from stillwater.sources import synthetic

    stack = pixel.display_scaled(pixel.mean_stack(frames(spark, sf_dir), ["label"]), ["label"]).drop("source_min", "source_max")
    big = gather.resized(stack, ["label"], 32, 32)
    return rounded(synthetic.simulate(big, ["label"], synthetic.Simulation(frame_count=3, downsample=2)), "v")
