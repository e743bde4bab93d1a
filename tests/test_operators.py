import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import array_of, image_table, structured
from stillwater.operators import convolve, estimate, gather, pixel, rank, spectral
from stillwater.plans import render

KEYS = ["image_id"]


def test_identical_images_have_perfect_metrics(spark):
    a = structured(8)
    t = image_table(spark, a=a)
    m = pixel.metrics(pixel.paired(t, t, KEYS), KEYS).first()
    assert m["mse"] == 0 and m["psnr_db"] == float("inf")
    assert m["ssim_global"] == pytest.approx(1) and m["gradient_correlation"] == pytest.approx(1)


def test_constant_sides_have_defined_correlation(spark):
    flat, ramp = np.ones((4, 4)), np.arange(16.0).reshape(4, 4)
    both = pixel.paired(image_table(spark, a=flat), image_table(spark, a=ramp), KEYS)
    assert pixel.gradient_correlation(both, KEYS).first()["gradient_correlation"] == 0
    same = pixel.paired(image_table(spark, a=flat), image_table(spark, a=flat), KEYS)
    assert pixel.gradient_correlation(same, KEYS).first()["gradient_correlation"] == 1


def test_non_finite_pixels_fail(spark):
    a = np.ones((2, 2))
    a[0, 0] = np.nan
    with pytest.raises(Exception, match="non-finite"):
        pixel.checked(image_table(spark, a=a)).collect()


def test_gradient_and_its_edges(spark):
    a = structured(6)
    dx = np.diff(a, axis=1)
    dy = np.diff(a, axis=0)
    want = np.hypot(np.c_[dx, dx[:, -1]], np.r_[dy, dy[-1:]])
    got = array_of(pixel.gradient(image_table(spark, a=a), KEYS).drop("v").withColumnRenamed("g", "v"))
    assert np.allclose(got, want)


def test_saturation_counts_strictly_outside(spark):
    a = np.array([[-0.1, 0.0], [1.0, 1.2]])
    r = pixel.saturation(image_table(spark, a=a), KEYS, 0.0, 1.0).first()
    assert (r["n_low"], r["n_high"], r["n_pixels"]) == (1, 1, 4)


def test_warp_error_of_a_constant_displacement(spark):
    t = image_table(spark, a=np.zeros((4, 4)))
    truth = t.select("image_id", "y", "x", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    estimate_ = t.select("image_id", "y", "x", F.lit(3.0).alias("u"), F.lit(4.0).alias("v"))
    assert pixel.warp_error(truth, estimate_, KEYS).first()[1:] == (5.0, 5.0, 5.0, 5.0)


def test_photometric_fit_recovers_a_linear_change(spark):
    ref = structured(8)
    pairs = pixel.paired(image_table(spark, a=ref), image_table(spark, a=(ref - 0.2) / 0.7), KEYS)
    fit = pixel.photometric_fit(pairs, KEYS).first()
    assert fit["scale"] == pytest.approx(0.7) and fit["offset"] == pytest.approx(0.2) and fit["mse_after"] < 1e-20
    flat = pixel.photometric_fit(pixel.paired(image_table(spark, a=ref), image_table(spark, a=np.ones((8, 8))), KEYS), KEYS).first()
    assert not flat["is_applied"] and flat["scale"] == 1


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (16, 16)])
def test_align_corners_resize(spark, shape):
    a = structured(9)
    got = array_of(gather.resized(image_table(spark, a=a), KEYS, *shape))
    assert np.allclose(got, estimate.upsampled(a, *shape))


def test_warp_by_zero_and_by_whole_pixels(spark):
    a = structured(8)
    t = image_table(spark, a=a)
    assert np.allclose(array_of(gather.warped(t, gather.constant_field(t, KEYS, 0.0, 0.0), KEYS)), a)
    moved = array_of(gather.warped(t, gather.constant_field(t, KEYS, 2.0, -1.0), KEYS))
    assert np.allclose(moved[:-1, 2:], a[1:, :-2])


def test_identity_affine_and_a_singular_matrix(spark):
    t = image_table(spark, a=structured(6))
    one, zero = F.lit(1.0), F.lit(0.0)
    assert np.allclose(array_of(gather.affine(t, KEYS, zero, one, zero, zero)), structured(6))
    with pytest.raises(Exception, match="singular"):
        gather.inverse_sampled(t, KEYS, one, one, one, one).collect()


def test_block_average_needs_a_multiple(spark):
    t = image_table(spark, a=structured(6))
    assert np.allclose(array_of(gather.block_average(t, KEYS, 3)), structured(6).reshape(2, 3, 2, 3).mean(axis=(1, 3)))
    with pytest.raises(Exception, match="multiple"):
        gather.block_average(t, KEYS, 4).collect()


def test_missing_pixels_are_left_out_of_centre_resize(spark):
    a = structured(4)
    a[0, 0] = np.nan
    got = array_of(gather.resized_centres(image_table(spark, a=a), KEYS, 2, 2))
    assert got[0, 0] == pytest.approx(np.nanmean(a[:2, :2])) and got[1, 1] == pytest.approx(a[2:, 2:].mean())


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_gaussian_matches_reflected_convolution(spark, n):
    a = structured(12)[:n, :n]
    k = convolve.gaussian_weights(1.3)
    want = a.copy()
    for axis in (1, 0):
        idx = np.arange(n)[:, None] + np.arange(-(len(k) // 2), len(k) // 2 + 1)
        period = max(1, 2 * (n - 1))
        idx = np.minimum(idx % period, period - idx % period) if n > 1 else np.zeros_like(idx)
        want = np.moveaxis(np.einsum("...ik,k->...i", np.moveaxis(want, axis, -1)[..., idx], k), -1, axis)
    assert np.allclose(array_of(convolve.gaussian(image_table(spark, a=a), KEYS, 1.3)), want)


def test_airy_kernel_adds_up_and_has_its_zero(spark):
    rows = convolve.airy_kernel(spark, 4.627586206896552).toPandas()
    assert rows.weight.sum() == pytest.approx(1) and rows.weight.min() >= 0
    assert abs(convolve.bessel_j1(np.array([convolve.FIRST_ZERO]))[0]) < 1e-12
    clear = convolve.airy_kernel(spark, 2.0, 0.0, 3.0).toPandas().weight.max()
    assert convolve.airy_kernel(spark, 2.0, 0.3, 3.0).toPandas().weight.max() != pytest.approx(clear)


def test_dense_convolution_matches_the_join(spark):
    a = structured(10)
    kernel = convolve.airy_kernel(spark, 1.0, 0.0, 2.0)
    dense = array_of(kernel.withColumnsRenamed({"weight": "v"}).selectExpr("oy + 2 as y", "ox + 2 as x", "v"))
    assert np.allclose(array_of(convolve.convolved(image_table(spark, a=a), kernel, KEYS)), convolve.convolve_array(a, dense))


def test_spectrum_equals_fft_and_inverts(spark):
    a = structured(9)[:, :6]
    t = image_table(spark, a=a)
    s = spectral.dft(t, KEYS)
    pdf = s.toPandas()
    got = np.zeros(a.shape, complex)
    got[pdf.ky, pdf.kx] = pdf.re + 1j * pdf.im
    assert np.allclose(got, np.fft.fft2(a))
    assert np.allclose(array_of(spectral.inverse_dft(s, KEYS)), a)
    assert np.allclose(array_of(spectral.high_pass(t, KEYS, 0.6)), spectral.high_pass_array(a, 0.6))
    assert np.allclose(array_of(spectral.high_pass_dense(t, KEYS, 0.6)), spectral.high_pass_array(a, 0.6))


@pytest.mark.parametrize("shape", [(10, 10), (9, 6)])
def test_dense_and_relational_spectra_agree(spark, shape):
    a, b = structured(12)[: shape[0], : shape[1]], structured(12).T[: shape[0], : shape[1]] ** 2
    truth, made = image_table(spark, a=a).drop("image_id"), image_table(spark, b=b, c=a)
    for cutoff in (0.6, 0.4):  # frequencies on the cutoff stay in both
        plain, dense = (f(made, KEYS, cutoff) for f in (spectral.high_pass, spectral.high_pass_dense))
        for name in "bc":
            assert np.allclose(array_of(dense, image_id=name), array_of(plain, image_id=name), atol=1e-9)
    plain, dense = (spectral.radial_curve(truth, made, KEYS, 4, f).orderBy("image_id", "bin").toPandas() for f in (spectral.dft, spectral.dft_dense))
    assert list(plain.columns) == list(dense.columns) and (plain.fourier_sample_count == dense.fourier_sample_count).all()
    assert np.allclose(plain.drop(columns="image_id").astype(float), dense.drop(columns="image_id").astype(float), atol=1e-9, equal_nan=True)


def test_dense_spectra_of_large_and_of_no_images(spark):
    a = structured(256)
    t = image_table(spark, a=a)
    curve = spectral.radial_curve(t, t, KEYS, 8, spectral.dft_dense).toPandas()
    assert len(curve) == 8 and np.allclose(curve.correlation, 1)
    assert spectral.dft_dense(t.filter("false"), KEYS).isEmpty() and spectral.dft_dense(t.filter("false").drop("image_id"), []).isEmpty()


@pytest.mark.parametrize("obstruction", [0.0, 0.3])
def test_airy_weights_and_both_routes_agree(spark, obstruction):
    a, weights = structured(20)[:, :14], convolve.airy_array(0.9, obstruction)
    radius = len(weights) // 2
    kernel = convolve.airy_kernel(spark, 0.9, obstruction)
    assert np.allclose(array_of(kernel.selectExpr(f"oy + {radius} as y", f"ox + {radius} as x", "weight as v")), weights, atol=1e-12)
    plain = array_of(convolve.convolved(image_table(spark, a=a), kernel, KEYS))
    assert np.allclose(array_of(convolve.dense(image_table(spark, a=a), KEYS, lambda x: convolve.convolve_array(x, weights))), plain, atol=1e-9)
    assert np.allclose(array_of(render.telescope_reference(image_table(spark, a=a), KEYS, 0.0, airy_r0=0.9, obstruction=obstruction)), plain, atol=1e-9)


def test_identity_recovers_all_frequencies_and_sign_flips_are_unsupported(spark):
    a = structured(16)
    t = image_table(spark, a=a)
    curve = spectral.radial_curve(t, t, KEYS, 4)
    assert spectral.recovery_limit(curve, KEYS).first()["recovery_limit"] == pytest.approx(0.875)
    high = spectral.high_pass_array(a, 0.6)
    flipped = image_table(spark, a=a - 2 * high)
    pairs = pixel.paired(spectral.high_pass(t, KEYS), spectral.high_pass(flipped, KEYS), KEYS)
    assert spectral.false_detail(pairs, KEYS).first()["unsupported_energy_fraction"] > 0.6


def test_recovery_limit_skips_leading_failures_and_empty_bins(spark):
    rows = [(0, 0.125, 0.2), (1, 0.375, None), (2, 0.625, 0.9), (3, 0.875, 0.8), (4, 1.125, 0.1), (5, 1.375, 0.9)]
    curve = spark.createDataFrame(rows, "bin int, frequency_mid_fraction double, correlation double").withColumn("image_id", F.lit("a"))
    assert spectral.recovery_limit(curve, KEYS).first()["recovery_limit"] == 0.875
    none = curve.withColumn("correlation", F.lit(0.1))
    assert spectral.recovery_limit(none, KEYS).first()["recovery_limit"] == 0.0


def test_empty_bins_have_no_values(spark):
    t = image_table(spark, a=structured(4))
    rows = spectral.radial_curve(t, t, KEYS, 16).toPandas().set_index("bin")
    assert rows.fourier_sample_count.sum() == 11 and rows[rows.fourier_sample_count == 0].correlation.isna().all()


@pytest.mark.parametrize("shift", [(2, -1), (-3, 2), (0, 0)])
def test_phase_correlation_finds_whole_shifts(spark, shift):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(32, 32))
    moving = np.roll(a, (shift[1], shift[0]), axis=(0, 1))
    assert estimate.phase_shift(a, moving) == shift
    assert estimate.phase_shift(np.ones((8, 8)), np.ones((8, 8))) == (0, 0)


def test_translation_stack_beats_the_mean_stack(spark):
    rng = np.random.default_rng(2)
    scene = rng.random((32, 32))
    shifts = [(0, 0), (2, -1), (-3, 2), (1, 1)]
    frames = image_table(spark, **{str(i): np.roll(scene, (v, u), axis=(0, 1)) for i, (u, v) in enumerate(shifts)})
    frames = frames.select(F.lit("c").alias("case_id"), F.col("image_id").cast("int").alias("frame"), "y", "x", "v")
    error = lambda df: float(np.mean((array_of(df)[4:-4, 4:-4] - scene[4:-4, 4:-4]) ** 2))
    assert error(estimate.translation_stack(frames, ["case_id"])) < 0.05 * error(pixel.mean_stack(frames, ["case_id"]))


def test_trailing_blocks_are_four_pixels():
    assert estimate.block_edges(10, 4) == [(0, 4), (4, 8), (6, 10)]


def test_registration_keeps_the_first_of_equals(spark):
    t = image_table(spark, a=np.ones((6, 6)))
    best = estimate.registration(t, t, KEYS, (-5.0, 0.0, 5.0), (1.0,)).first()
    assert best["ordinal"] == 0 and best["method"] == "global_similarity_grid_search"
    a = image_table(spark, a=structured(12))
    assert estimate.registration(a, a, KEYS, (-5.0, 0.0, 5.0), (0.9, 1.0), (0.0, 0.1)).first()["rotation"] == 0.0


def test_oracle_stack_wants_all_fields(spark):
    frames = spark.createDataFrame([("c", 1, 0, 0, 0.5), ("c", 2, 0, 0, 0.7)], "case_id string, frame int, y int, x int, v double")
    truth = frames.filter("frame = 1").select("case_id", "frame", "y", "x", F.lit(0.0).alias("u"), F.lit(0.0).alias("w_v"))
    with pytest.raises(ValueError, match="do not match"):
        estimate.oracle_stack(frames, truth, ["case_id"])


def test_ranks_and_leaders_break_ties_by_order(spark):
    rows = spark.createDataFrame([(0, "a", 0.5, None), (1, "b", 0.5, 2.0), (2, "c", 0.9, 2.0)], "ordinal int, algorithm string, score double, reconstruction_runtime_s double")
    assert [r["algorithm"] for r in rank.ranked(rows, "score", "ordinal").orderBy("rank").collect()] == ["c", "a", "b"]
    best = {r["metric"]: r["algorithm"] for r in rank.leaders(rows, "ordinal").collect()}
    assert best == {"score": "c", "reconstruction_runtime_s": "b"}


def test_unknown_levels_count_as_medium(spark):
    rows = spark.createDataFrame([(1, "a", "low"), (1, "b", "odd"), (2, "a", "low")], "k int, factor string, level string")
    assert {r["k"]: r["risk_level"] for r in rank.uncertainty(rows, ["k"]).collect()} == {1: "medium", 2: "low"}
