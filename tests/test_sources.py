import io
import os
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import array_of, image_table, structured
from stillwater import cli
from stillwater.functions import geometry, telescope, text
from stillwater.operators import datasets
from stillwater.plans import evaluate, products, render, study
from stillwater.sources import cases, fetch, images, labels, raster, reports, synthetic, tiff
from stillwater.streaming import stacks


def test_tiff_round_trip_within_half_a_level():
    a = structured(7)[:, :5]
    assert np.abs(tiff.decode(tiff.encode(a)) - a).max() <= 1 / 131070 + 1e-12
    with pytest.raises(ValueError):
        tiff.encode(a + 1)


def test_tiff_of_eight_bits_big_endian():
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1)]
    raw = struct.pack(">2sHI", b"MM", 42, 12) + bytes([0, 85, 170, 255]) + struct.pack(">H", len(tags))
    raw += b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    assert np.allclose(tiff.decode(raw), np.array([[0, 85], [170, 255]]) / 255)
    with pytest.raises(ValueError):
        tiff.decode(b"GIF89a..")


def test_images_load_by_suffix(spark, tmp_path):
    a = structured(6)
    np.save(tmp_path / "a.npy", a.astype("f4"))
    (tmp_path / "b.tif").write_bytes(tiff.encode(a))
    got = images.load(spark, str(tmp_path)).toPandas()
    assert len(got) == 2 and all(np.allclose(np.reshape(d, (6, 6)), a, atol=1e-5) for d in got.data)
    (tmp_path / "c.png").write_bytes(b"x")
    with pytest.raises(Exception, match="suffix"):
        images.load(spark, str(tmp_path)).collect()


def test_raster_window(spark, tmp_path):
    path = str(tmp_path / "p.img")
    np.arange(100, dtype="<i2").tofile(path)
    got = raster.load(spark, path, sample_type="SignedLSB2", line_samples=10, row_start=3, row_stop=7, col_start=2, col_stop=5, rows_per_task=2)
    assert got.rdd.getNumPartitions() == 2
    assert np.array_equal(array_of(got), np.arange(100.0).reshape(10, 10)[3:7, 2:5])
    with pytest.raises(Exception, match="ends within"):
        raster.load(spark, path, sample_type="SignedLSB2", line_samples=10, row_start=8, row_stop=12, col_start=0, col_stop=5).collect()


def test_labels_of_both_forms(spark, tmp_path):
    (tmp_path / "a.lbl").write_text('PRODUCT_ID = "X1" /* c */\nLINES = 10\nLINE_SAMPLES = 20\nMAP_SCALE = 100.5 <m/pixel>\nODD = 1\nLINES = 12\n')
    (tmp_path / "b.xml").write_text("<?xml version='1.0'?><Product xmlns='http://x'><title>T</title><File><file_name>b.img</file_name></File><Array_2D_Image><Axis_Array><axis_name>Line</axis_name><elements>7</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>9</elements></Axis_Array><data_type>SignedLSB2</data_type></Array_2D_Image></Product>")
    rows = {os.path.basename(r["path"]): r for r in labels.summary(labels.parsed(labels.files(spark, str(tmp_path)))).collect()}
    assert rows["a.lbl"]["lines"] == 12 and rows["a.lbl"]["map_scale"] == 100.5 and rows["a.lbl"]["provenance"]["product_id"] == "X1"
    assert (rows["b.xml"]["lines"], rows["b.xml"]["line_samples"], rows["b.xml"]["sample_type"], rows["b.xml"]["product_file_name"]) == (7, 9, "SignedLSB2", "b.img")


XML = """<?xml version="1.0"?><Product_Observational xmlns:c="http://x/c"><title> A tile </title><citation_desc>cited</citation_desc><description>not this</description><modification_date>2024-01-02</modification_date>
<c:pixel_resolution_x unit="deg/pixel">0.004</c:pixel_resolution_x><c:pixel_scale_x unit="m/pixel"> 99.5 </c:pixel_scale_x><c:sample_bit_mask>2#1111111111111111</c:sample_bit_mask><data_type>Other</data_type>
<Axis_Array><axis_name>Line</axis_name><elements>18</elements></Axis_Array><Axis_Array><axis_name>sample</axis_name><elements>27</elements></Axis_Array>%s</Product_Observational>"""
ARRAY = "<Array_2D_Image><offset unit='byte'>%s</offset><Element_Array><data_type>%s</data_type></Element_Array><missing_constant>%s</missing_constant></Array_2D_Image>"


def test_xml_labels_name_scale_bits_and_the_first_array(spark, tmp_path):
    (tmp_path / "none.xml").write_text(XML % "")
    (tmp_path / "two.xml").write_text(XML % (ARRAY % (512, "SignedLSB2", -32768) + ARRAY % (9, "Late", 0)))
    rows = {os.path.basename(r["path"]): r for r in labels.summary(labels.parsed(labels.files(spark, str(tmp_path)))).collect()}
    for r in rows.values():
        assert (r["map_scale"], r["map_resolution"], r["lines"], r["line_samples"], r["sample_bits"]) == (99.5, 250.0, 18, 27, 16)
        assert r["provenance"] == {"title": "A tile", "citation_description": "cited", "product_creation_time": "2024-01-02"}
    assert (rows["none.xml"]["sample_type"], rows["none.xml"]["array_offset_bytes"], rows["none.xml"]["missing_constant"]) == ("Other", None, None)
    assert (rows["two.xml"]["sample_type"], rows["two.xml"]["array_offset_bytes"], rows["two.xml"]["missing_constant"]) == ("SignedLSB2", 512, "-32768")


def test_checksum_table_last_wins(spark, tmp_path):
    a, b = "a" * 32, "b" * 32
    (tmp_path / "t").write_text(f"{a}  ./k/x.bsp\nnonsense line here\n{b}  k/x.bsp\n")
    assert [tuple(r) for r in labels.checksums(spark, str(tmp_path / "t")).collect()] == [("k/x.bsp", b)]


def test_cases_keep_truth_apart(spark, tmp_path):
    frames = spark.createDataFrame([("c", 1, 0, 0, 0.5), ("c", 2, 0, 0, 1.5)], "case_id string, frame int, y int, x int, v double")
    cases.save(str(tmp_path), frames=frames, latent=frames.filter("frame = 1").drop("frame"))
    assert cases.frames(spark, str(tmp_path), "c", 2).first()["v"] == 1.0
    assert sorted(os.listdir(tmp_path)) == ["input", "truth"]
    with pytest.raises(ValueError):
        cases.save(str(tmp_path), nonsense=frames)


class Served:
    def __init__(self, raw, kind="text/plain", length=True):
        self.raw, self.headers = io.BytesIO(raw), {"Content-Type": kind} | ({"Content-Length": str(len(raw))} if length else {})

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self, n=-1):
        return self.raw.read(n)


def test_fetches_are_bounded_and_leave_nothing(tmp_path):
    to = str(tmp_path / "x")
    assert fetch.text("http://h/x", to, opener=lambda u: Served(b"abc")) == to
    for served in (Served(b"abcd"), Served(b"abcd", length=False)):
        with pytest.raises(ValueError):
            fetch.text("http://h/x", to, 3, opener=lambda u, s=served: s)
    with pytest.raises(ValueError):
        fetch.binary("http://h/x", str(tmp_path / "y"), 3, opener=lambda u: Served(b"abcd"))
    assert sorted(os.listdir(tmp_path)) == ["x"]
    with pytest.raises(ValueError):
        fetch.target("/root", "../x")
    with pytest.raises(ValueError):
        fetch.checked_url("ftp://h/x")
    row = {"url": "http://h/p", "destination": "p", "expected_size": 3, "checksum": "md5:900150983cd24fb0d6963f7d28e17f72"}
    assert fetch.products([row], str(tmp_path), 3, opener=lambda u: Served(b"abc"))
    with pytest.raises(ValueError, match="budget"):
        fetch.products([row], str(tmp_path), 2, opener=lambda u: Served(b"abc"))


def test_reports_have_no_bare_infinities(tmp_path):
    path = reports.write_json({"a": float("inf"), "b": [float("nan")]}, str(tmp_path / "r.json"))
    assert reports.read_json(path) == {"a": "inf", "b": ["nan"]}


def test_default_telescope(spark):
    row = spark.range(1).select(*telescope.bundle(*map(F.lit, (200.0, 4000.0, 550.0, 2.9, 0.0)))).first()
    assert row["cutoff_fraction_of_nyquist"] == pytest.approx(0.5272727272727272) and row["gaussian_sigma_px"] == pytest.approx(1.65597, rel=1e-4) and row["airy_first_zero_px"] == pytest.approx(4.627586206896552)


def test_projection_at_the_centre_is_the_identity(spark):
    zero = F.lit(0.0)
    row = spark.range(1).select(*geometry.projection(zero, zero, zero, zero)).first()
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(0) and row[3] == pytest.approx(1) and row[4] == pytest.approx(1)
    with pytest.raises(Exception, match="not visible"):
        spark.range(1).select(*geometry.projection(F.lit(0.0), F.lit(170.0), zero, zero)).collect()


def test_shading_of_flat_and_sloping_ground(spark):
    flat = image_table(spark, a=np.zeros((4, 4)))
    up, sun = tuple(map(F.lit, (0.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 0.0, 1.0)))
    assert np.allclose(array_of(geometry.shaded(flat, ["image_id"], 100.0, sun)), 1)
    ramp = image_table(spark, a=np.tile(np.arange(4) * 100.0, (4, 1)))
    assert np.allclose(array_of(geometry.shaded(ramp, ["image_id"], 100.0, sun)), 2**-0.5)
    assert np.allclose(array_of(geometry.shaded(flat, ["image_id"], 100.0, sun, up, "lommel_seeliger")), 1)


def test_text_functions(spark):
    row = spark.range(1).select(text.safe_name(F.lit("a b-ß!")), text.archive_path(F.lit("..\\x/y")), text.kernel_type(F.lit("k/a.TPC")), text.bit_count(F.lit("10110")), text.relative_path(F.lit("a/../b")), text.web_address(F.lit("https://h/x"))).first()
    assert tuple(row) == ("a_b_ß", "x/y", "pck", 3, False, True)
    assert text.slug(-0.5) == "m0p5" and text.slug(2.0) == "2" and text.shown(None) == "n/a"


def test_full_span_tile_wraps(spark):
    f = {"minimum_latitude": -10.0, "maximum_latitude": 10.0, "westernmost_longitude": 270.0, "easternmost_longitude": 360.0}
    fields = {k: F.lit(v) for k, v in f.items()}
    cover = lambda lon: spark.range(1).select(datasets.coverage(F.lit(0.0), F.lit(lon), fields)).first()[0]
    assert cover(-20.0) == "ok" and cover(20.0) == "outside"


def test_simulation_is_seeded_and_normalised(spark):
    a = structured(16)
    config = synthetic.Simulation(frame_count=2)
    one, two = synthetic.simulate_case(a, config, 3), synthetic.simulate_case(a, config, 3)
    assert np.array_equal(one["frames"], two["frames"]) and not np.array_equal(one["frames"], synthetic.simulate_case(a, config, 4)["frames"])
    large = one["component_large"]
    assert np.allclose(large.std(axis=(1, 2)), 1.5) and np.allclose(large.mean(axis=(1, 2)), 0)
    assert np.array_equal(one["latent"], a)
    with pytest.raises(ValueError, match="unknown"):
        synthetic.Simulation.from_record({"frames": 3})


def test_study_refuses_before_it_starts(spark):
    one = study.Algorithm("a", builtin="mean_stack")
    with pytest.raises(ValueError, match="two"):
        study.validate([one])
    with pytest.raises(ValueError, match="repeat"):
        study.validate([one, one])
    tool = study.Algorithm("t", kind="command", command=("no-such-tool-here",))
    frames = image_table(spark, a=structured(8)).selectExpr("image_id as case_id", "1 as frame", "y", "x", "v")
    with pytest.raises(RuntimeError, match="command_executable_not_found"):
        study.study(frames, frames.drop("frame"), [one, tool], ["case_id"])


def test_sweep_rows_and_oracle(spark):
    config = study.Sweep(warp_strengths=(1.0,), noise_sigmas=(0.0, 0.05), algorithms=("single_frame", "mean_stack", "oracle_aligned_stack"), base=synthetic.Simulation(frame_count=4, seeing_blur_px=0.0, psf_sigma_px=0.0), size=16)
    rows = study.sweep(image_table(spark, a=structured(16)).drop("image_id"), config, bins=4).toPandas()
    assert len(rows) == 6 and rows.score.notna().all()
    mse = rows.set_index(["scenario", "algorithm"]).mse
    assert (mse.xs("oracle_aligned_stack", level=1) < mse.xs("mean_stack", level=1)).all()


def test_reference_evaluation_reports_uncertainty(spark):
    ref = image_table(spark, a=structured(8)).drop("image_id")
    made = image_table(spark, r=0.5 * structured(8) + 0.1)
    row = evaluate.against_reference(ref, made, ["image_id"], "none", "linear_least_squares", ["not_spice_backed"], bins=4).first()
    assert row["risk_level"] == "high" and row["mse"] < 1e-20
    moved = evaluate.registered(ref, made, ["image_id"], "grid", rotations=(0.0,), scales=(1.0,))
    assert np.allclose(array_of(moved), 0.5 * structured(8) + 0.1)


def test_reference_rendering(spark):
    source = image_table(spark, a=structured(8))
    assert np.allclose(array_of(render.telescope_reference(source, ["image_id"], 0.0, projection=(1, 0, 0, 1))), structured(8))
    bad = image_table(spark, a=np.full((4, 4), np.nan))
    with pytest.raises(Exception, match="non-finite"):
        render.telescope_reference(bad, ["image_id"], 1.0).collect()


def test_running_stack(spark, tmp_path):
    frames = spark.createDataFrame([("c", i, 0, 0, float(i)) for i in range(4)], stacks.FRAME)
    frames.repartition(4).write.parquet(str(tmp_path / "in"))
    q = stacks.start(stacks.running_stack(stacks.frames(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("n_frames")).first()
    assert last["n_frames"] == 4 and last["v"] == 1.5


def test_command_line_end_to_end(spark, tmp_path):
    d = lambda *p: str(tmp_path.joinpath(*p))
    assert cli.main(["simulate", "--out", d("case"), "--size", "16", "--frames", "3"]) == 0
    for method in ("mean_stack", "single_frame"):
        assert cli.main(["stack", "--case", d("case"), "--out", d(method), "--method", method]) == 0
        assert cli.main(["evaluate", "--case", d("case"), "--result", d(method), "--out", d(f"{method}.json"), "--bins", "4"]) == 0
    assert cli.main(["compare", "--out", d("c.md"), d("mean_stack.json"), d("single_frame.json")]) == 0
    assert cli.main(["report", "--out", d("r.md"), d("mean_stack.json")]) == 0
    assert "Leaders" in open(d("c.md")).read() and "ssim_global" in open(d("r.md")).read()


def test_configured_study_runs_all_kinds(spark, tmp_path):
    d = lambda *p: str(tmp_path.joinpath(*p))
    assert cli.main(["simulate", "--out", d("case"), "--size", "16", "--frames", "3", "--warp", "0.5"]) == 0
    np.save(d("made.npy"), np.full((16, 16), 0.5))
    tool = "import sys, numpy; numpy.save(sys.argv[1] + '/reconstruction.npy', numpy.linspace(0, 1, 256).reshape(16, 16))"
    record = {"algorithms": [{"name": "mean", "builtin": "mean_stack"}, {"name": "by tool", "kind": "command", "command": [sys.executable, "-c", tool, "{result}"]}, {"name": "old", "kind": "existing_result", "result": d("made.npy")}]}
    reports.write_json(record, d("study.json"))
    assert cli.main(["study", "--config", d("study.json"), "--case", d("case"), "--out", d("out"), "--bins", "4"]) == 0
    rows = spark.read.parquet(d("out", "reports")).orderBy("ordinal").collect()
    assert [r["algorithm"] for r in rows] == ["mean", "by tool", "old"] and [r["reconstruction_runtime_s"] is None for r in rows] == [True, False, True]
    reference = image_table(spark, a=structured(16)).drop("image_id")
    scored = study.configured(spark, record, d("case"), d("out2"), reference, bins=4, record={"references": []}).collect()
    assert {r["risk_level"] for r in scored} == {"medium"} and len(scored) == 3
    assert os.path.exists(d("out2", "results", "1_by_tool", "command.json"))
    record["algorithms"][2]["result"] = d("nothing.npy")
    with pytest.raises(RuntimeError, match="result_reconstruction_not_found"):
        study.configured(spark, record, d("case"), d("out3"))
    assert not os.path.exists(d("out3", "results", "1_by_tool", "command.json"))
    assert cli.main(["import-result", "--result", d("made.npy"), "--out", d("imported"), "--name", "hand"]) == 0
    assert spark.read.parquet(d("imported", "reconstruction")).count() == 256
    assert cli.main(["diagnostics", "--case", d("case"), "--result", d("imported", "reconstruction"), "--out", d("maps"), "--bins", "4"]) == 0
    assert {"truth", "reconstruction", "residual", "edge", "false_detail", "blink", "frequency_recovery"} <= set(os.listdir(d("maps")))


def test_reference_records_name_what_they_lack(spark):
    row = {"output": "a.tif", "role": "albedo", "label_provenance": {"title": "t"}}
    assert evaluate.reference_row({"references": [row, {"output": "b.tif"}]}, "b.tif") == {"output": "b.tif"}
    assert evaluate.reference_row({"references": [row]}, "other") == row and evaluate.reference_row({"references": [row, row]}, "other") == {} and evaluate.reference_row(None, "x") == {}
    image = image_table(spark, a=structured(8)).drop("image_id")
    made = image_table(spark, r=structured(8))
    sources = lambda **k: [f["source"] for f in evaluate.against_reference(image, made, ["image_id"], bins=4, **k).first()["uncertainty"]]
    assert sources(record={}) == ["reference_provenance_missing", "reference_generation_missing", "no_reference_limitations_reported", "geometric_registration_not_applied", "photometric_normalization_not_applied"]
    assert sources(record={"references": [row], "limitations": ["not_spice_backed"]}, output="a.tif", photometry="linear_least_squares") == ["not_spice_backed", "geometric_registration_not_applied", "global_linear_photometric_normalization"]
    factors = evaluate.against_reference(image, made, ["image_id"], "grid", grid={"rotations": (0.0, 1.0), "scales": (1.0,), "shears_x": (0.0, 0.1)}, bins=4).first()["uncertainty"]
    assert (factors[0]["source"], factors[0]["candidate_count"]) == ("global_affine_registration", 4)


def test_documents_labels_and_products_by_name(tmp_path):
    asked = []

    def opener(url):
        asked.append(url)
        return Served(b"text")

    rows = [{"name": "a", "label_url": "http://x/a.lbl", "label_local_path": "l/a.lbl"}, {"name": "b", "label_url": "http://x/again.lbl", "label_local_path": "l/a.lbl"}, {"name": "c", "label_url": None, "label_local_path": None}]
    assert fetch.product_labels(rows, str(tmp_path), opener) == [str(tmp_path / "l/a.lbl")] and asked == ["http://x/a.lbl"]
    assert fetch.documents([{"url": "http://x/d.txt", "local_path": "d.txt", "expected_max_bytes": 10}], str(tmp_path), opener) == [str(tmp_path / "d.txt")]
    with pytest.raises(ValueError):
        fetch.documents([{"url": "http://x/d.txt", "local_path": "d.txt", "expected_max_bytes": 2}], str(tmp_path), opener)
    assert fetch.named(rows, ["b"]) == [rows[1]] and fetch.named(rows, None) == rows
    with pytest.raises(ValueError, match="no such product"):
        fetch.named(rows, ["z"])


def test_directory_size_and_reference_by_role(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a").write_bytes(b"123")
    (tmp_path / "in" / "b").write_bytes(b"4567")
    assert products.directory_size(spark, str(tmp_path)) == 7
    rows = spark.createDataFrame([(1, "terrain", "t"), (0, "albedo", "a"), (2, "terrain", "u")], "ordinal int, role string, output string")
    assert render.chosen(rows).first()["output"] == "a" and render.chosen(rows, "terrain").first()["output"] == "t" and render.chosen(rows, "none").isEmpty()


def test_markdown_report_tells_of_the_reference():
    record = {"limitations": ["not_spice_backed"], "references": [{"output": "r.tiff", "method": "gaussian", "label_provenance": {"title": "A mosaic"}}]}
    known = evaluate.reference_metadata(record, "r.tiff", ["asked"])
    assert known["reference_limitations"] == ["asked", "not_spice_backed"] and known["reference_generation"] == {"output": "r.tiff", "method": "gaussian"}
    report = {"algorithm": "x", "image_similarity": {"mse": 0.5}, "risk_level": "high", "uncertainty": [{"source": "s", "level": "high", "description": "why"}], "metadata": {**known, "evaluation_runtime_s": 1.5}, "diagnostics": {"residual": "a.png"}}
    text = reports.metrics_markdown(report)
    for part in ("- `not_spice_backed`", "- Risk level: `high`", "- `high` `s`: why", "- title: `A mosaic`", "- method: `gaussian`", "- evaluation: 1.5 s", "- residual: `a.png`", "| mse | 0.5 |"):
        assert part in text
    assert "##" not in reports.metrics_markdown({"algorithm": "x"})
    assert evaluate.reference_metadata(None, "r") == {"reference_limitations": [], "reference_provenance": {}, "reference_generation": {}}


def test_evaluation_against_a_reference_writes_what_is_known_of_it(spark, tmp_path):
    reference, out = str(tmp_path / "r.npy"), str(tmp_path / "m.json")
    np.save(reference, structured(8))
    image_table(spark, a=structured(8)).selectExpr("'c' AS case_id", "image_id AS algorithm", "y", "x", "v").write.parquet(str(tmp_path / "made"))
    record = reports.write_json({"limitations": ["not_spice_backed"], "references": [{"output": reference, "method": "gaussian"}]}, str(tmp_path / "record.json"))
    assert cli.main(["evaluate-reference", "--result", str(tmp_path / "made"), "--reference", reference, "--record", record, "--bins", "4", "--out", out]) == 0
    got = reports.read_json(out)["reports"][0]
    assert got["metadata"]["reference_generation"]["method"] == "gaussian" and got["metadata"]["evaluation_runtime_s"] > 0
    assert cli.main(["report", out, "--out", str(tmp_path / "r.md")]) == 0
    assert "- `not_spice_backed`" in (tmp_path / "r.md").read_text()
