import json

import numpy as np

from stillwater import cli
from stillwater.plans import products
from stillwater.sources import fetch

MANIFEST = {
    "name": "tile", "source": "s", "version": "1", "expected_size": "200", "checksum": None, "local_destination": "data/t", "license": "free", "provenance": "p", "resolution": "r", "coordinate_system": "c", "notes": "",
    "metadata_documents": [],
    "product_files": [{"name": "p", "url": "https://h/p.img", "local_path": "data/t/p.img", "checksum": None, "label_url": "https://h/p.lbl", "label_local_path": "data/metadata/p.lbl"}],
}
LABEL = 'LINES = 10\nLINE_SAMPLES = 10\nMAP_SCALE = 1000.0 <m/pixel>\nMINIMUM_LATITUDE = 0\nMAXIMUM_LATITUDE = 10\nWESTERNMOST_LONGITUDE = 0\nEASTERNMOST_LONGITUDE = 10\nSAMPLE_TYPE = SignedLSB2\n'


def prepared(tmp_path, there=True):
    for d in ("data/t", "data/metadata", "m"):
        (tmp_path / "root" / d).mkdir(parents=True)
    m = json.loads(json.dumps(MANIFEST))
    np.arange(100, dtype="<i2").tofile(tmp_path / "root/data/t/p.img")
    m["product_files"][0] |= {"checksum": "md5:" + fetch.digest(str(tmp_path / "root/data/t/p.img"), "md5"), "expected_size_bytes": 200}
    if not there:
        (tmp_path / "root/data/t/p.img").unlink()
        (tmp_path / "root/data/t/other.img").write_bytes(b"x")
    (tmp_path / "root/m/tile.json").write_text(json.dumps(m))
    (tmp_path / "root/data/metadata/p.lbl").write_text(LABEL)
    (tmp_path / "roi.json").write_text(json.dumps({"name": "r", "description": "", "center_lat_deg": 5.0, "center_lon_deg": 5.0, "width_km": 4.0, "height_km": 6.0, "target_resolution_m_per_px": 1000.0, "required_products": [{"role": "terrain", "manifest": "m/tile.json", "required": True}]}))
    return ["--roi", str(tmp_path / "roi.json"), "--manifests", str(tmp_path / "root/m"), "--root", str(tmp_path / "root")]


def test_manifests_are_rows_whatever_they_hold(spark, tmp_path):
    bad = {**MANIFEST, "license": ""}
    worse = {**MANIFEST, "product_files": [{**MANIFEST["product_files"][0], "checksum": "crc:1"}]}
    for name, x in (("a", json.dumps(MANIFEST)), ("b", json.dumps(bad)), ("c", json.dumps(worse)), ("d", "{ not json")):
        (tmp_path / f"{name}.json").write_text(x)
    rows = {r["path"][-6]: r for r in products.validation(products.manifests(spark, str(tmp_path))).collect()}
    assert rows["a"]["is_valid"] and rows["a"]["status"] == "candidate" and rows["a"]["n_products"] == 1
    assert rows["b"]["error"] == "missing license" and rows["c"]["error"] == "unsound product file" and rows["d"]["error"] == "not JSON"


def test_region_from_manifest_to_its_own_grid(spark, tmp_path):
    args = prepared(tmp_path)
    assert cli.main(["roi-readiness", "--out", str(tmp_path / "ready.json"), *args]) == 0
    assert json.loads((tmp_path / "ready.json").read_text())[0]["is_ready"]
    cut = str(tmp_path / "cut")
    assert cli.main(["extract-roi", "--out", cut, *args]) == 0
    got = spark.read.parquet(cut).toPandas().sort_values(["y", "x"])
    assert np.array_equal(got.v.to_numpy().reshape(6, 4), np.arange(100.0).reshape(10, 10)[2:8, 3:7])
    assert cli.main(["reproject-roi", "--out", str(tmp_path / "grid"), "--source", cut, "--width-km", "2", "--height-km", "3", "--m-per-px", "1000"]) == 0
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 6


XML = """<?xml version="1.0"?><Product><pixel_resolution_x>0.03</pixel_resolution_x><pixel_scale_x>1000.0</pixel_scale_x><file_name>p.img</file_name>
<south_bounding_coordinate>0</south_bounding_coordinate><north_bounding_coordinate>10</north_bounding_coordinate><west_bounding_coordinate>0</west_bounding_coordinate><east_bounding_coordinate>10</east_bounding_coordinate>
<Array_2D_Image><offset unit="byte">64</offset><data_type>SignedLSB2</data_type><Axis_Array><axis_name>Line</axis_name><elements>10</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>10</elements></Axis_Array><missing_constant>34</missing_constant></Array_2D_Image></Product>"""


def test_an_array_behind_a_header_is_cut_out_at_its_offset(spark, tmp_path):
    args = prepared(tmp_path)
    product = tmp_path / "root/data/t/p.img"
    product.write_bytes(b"h" * 64 + product.read_bytes())
    manifest = json.loads((tmp_path / "root/m/tile.json").read_text())
    manifest["product_files"][0] |= {"checksum": "md5:" + fetch.digest(str(product), "md5"), "expected_size_bytes": 264}
    (tmp_path / "root/m/tile.json").write_text(json.dumps(manifest))
    (tmp_path / "root/data/metadata/p.lbl").write_text(XML)
    assert cli.main(["extract-roi", "--out", str(tmp_path / "cut"), *args]) == 0
    got = spark.read.parquet(str(tmp_path / "cut")).toPandas().sort_values(["y", "x"])
    want = np.arange(100.0).reshape(10, 10)[2:8, 3:7]
    assert np.array_equal(got.v.to_numpy().reshape(6, 4), np.where(want == 34, np.nan, want), equal_nan=True)


def test_documents_are_bounded_and_sources_told(spark, tmp_path):
    document = {"name": "d", "url": "https://h/d.txt", "local_path": "d.txt", "expected_max_bytes": 2_000_000, "purpose": ""}
    for name, x in (("a", {**MANIFEST, "metadata_documents": [document]}), ("b", {**MANIFEST, "source": "https://h/x", "metadata_documents": [{**document, "expected_max_bytes": 10}]}), ("c", MANIFEST)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    rows = {r["path"][-6]: r for r in products.validation(products.manifests(spark, str(tmp_path))).collect()}
    assert rows["a"]["error"] == "unsound metadata document" and rows["b"]["is_valid"] and rows["b"]["source_error"] is None
    assert rows["c"]["source_error"] == "source is no http(s) address"


def test_missing_products_block_and_are_planned(spark, tmp_path):
    args = prepared(tmp_path, there=False)
    assert cli.main(["roi-readiness", "--out", str(tmp_path / "ready.json"), *args]) == 1
    assert json.loads((tmp_path / "ready.json").read_text())[0]["missing_required_roles"] == ["terrain"]
    assert cli.main(["roi-download-plan", "--out", str(tmp_path / "plan.json"), *args]) == 0
    plan = json.loads((tmp_path / "plan.json").read_text())
    assert [(p["kind"], p["destination"], p["expected_size"]) for p in plan] == [("product", "data/t/p.img", 200)]
    assert cli.main(["extract-roi", "--out", str(tmp_path / "cut"), *args]) == 1
    assert json.loads((tmp_path / "cut.skipped.json").read_text())[0]["reason"] == "missing_product_file"
