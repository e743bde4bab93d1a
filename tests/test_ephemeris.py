import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater import cli
from stillwater.plans import ephemeris


class Library:
    """Identity rotations, the Moon on the x axis, the Sun beyond it."""

    def utc2et(self, utc):
        return 0.0

    def pxform(self, a, b, et):
        return np.eye(3)

    def spkpos(self, target, et, frame, correction, observer):
        return ([384400.0, 0.0, 0.0] if target == "MOON" else [0.0, 1.5e8, 0.0]), 1.3

    def bodvrd(self, body, item, n):
        raise ValueError("no constants")

    def georec(self, lon, lat, alt, re, f):
        return [0.0, 0.0, 0.0]

    def furnsh(self, path):
        self.loaded = [*getattr(self, "loaded", []), path]


def test_geometry_of_a_known_sky(spark, tmp_path):
    (tmp_path / "o.json").write_text("﻿" + json.dumps({"utc_start": "2026-08-15T00:46:34Z", "observer": {"latitude": 1.0, "longitude": 2.0, "altitude_m": 3.0}, "spice": {"kernels": ["k/a.bsp"]}}))
    rows = ephemeris.observations(spark, str(tmp_path / "o.json"))
    got = ephemeris.derived(ephemeris.vectors(rows, Library())).first()
    assert got["earth_moon_distance_m"] == 384400000.0 and got["phase_angle_deg"] == pytest.approx(90) and got["illuminated_fraction"] == pytest.approx(0.5)
    assert got["sub_observer_longitude_deg_east"] == pytest.approx(180) and got["sub_solar_longitude_deg_east"] == pytest.approx(90)
    assert got["moon_angular_radius_deg"] == pytest.approx(np.degrees(np.arcsin(1737.4 / 384400)))


def test_readiness_lists_every_reason(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"utc_start": "x", "observer": {"latitude": None}, "spice": {"kernels": ["k/a.bsp", "k/b.bsp"]}}))
    (tmp_path / "b.json").write_text(json.dumps({"observer": None, "spice": None}))
    rows = ephemeris.observations(spark, str(tmp_path))
    files = spark.createDataFrame([("k/a.bsp", bytearray(b"x"))], "path string, content binary")
    table = spark.createDataFrame([("k/a.bsp", "0" * 32)], "archive_path string, md5 string")
    got = {r["path"][-6]: r for r in ephemeris.readiness(rows, files, table).collect()}
    assert got["a"]["reasons"] == ["kernel_checksum_mismatch", "kernel_file_missing", "kernel_not_in_checksum_table", "missing_observer.altitude_m", "missing_observer.latitude", "missing_observer.longitude"]
    assert got["b"]["reasons"] == sorted(["missing_utc_start", "missing_observer.latitude", "missing_observer.longitude", "missing_observer.altitude_m", "missing_spice.kernels"]) and not got["b"]["is_ready"]
    ready = rows.filter("spice IS NOT NULL").withColumn("observer", F.struct(F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(1.0).alias("altitude_m"))).withColumn("spice", F.struct(F.array(F.lit("k/a.bsp")).alias("kernels")))
    good = table.withColumn("md5", F.md5(F.lit("x")))
    assert ephemeris.readiness(ready, files, good).first()["is_ready"]


def test_reports_of_kernels_and_geometry(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"utc_start": "2026-08-15T00:46:34Z", "observer": {"latitude": 1.0, "longitude": 2.0, "altitude_m": 3.0}, "spice": {"kernels": ["k/spk/a.bsp", "k/b.tls"]}}))
    (tmp_path / "m.json").write_text(json.dumps({"name": "n", "local_destination": "k", "metadata_documents": [{"local_path": "k/checksum_old.txt"}, {"local_path": "k/checksum.tab"}]}))
    (tmp_path / "k" / "spk").mkdir(parents=True)
    paths, library = [str(tmp_path / n) for n in ("o.json", "m.json")], Library()
    none = ephemeris.kernel_report(spark, *paths, str(tmp_path), library)
    assert none["blocking_reasons"] == ["checksum_table_missing", "kernel_file_missing", "kernel_not_in_checksum_table"] and none["checksum_table"]["status"] == "missing"
    lacking = ephemeris.geometry_report(spark, paths[0], str(tmp_path), library)
    assert lacking["geometry"] is None and lacking["blocking_reasons"] == ["kernel_file_missing"]
    (tmp_path / "k" / "spk" / "a.bsp").write_text("a")
    (tmp_path / "k" / "b.tls").write_text("changed")
    md5 = {n: spark.range(1).select(F.md5(F.lit(n))).first()[0] for n in "ab"}
    (tmp_path / "k" / "checksum.tab").write_text(f"{md5['a']}  ./spk/a.bsp\n{md5['b']}  b.tls\n{md5['b']}  readme.txt\n")
    bad = ephemeris.kernel_report(spark, *paths, str(tmp_path), library)
    assert bad["blocking_reasons"] == ["kernel_checksum_mismatch"] and bad["checksum_table"]["entry_count"] == 3 and bad["checksum_table"]["kernel_type_counts"] == {"lsk": 1, "spk": 1}
    assert [(k["archive_path"], k["checksum_status"]) for k in bad["kernels"]] == [("b.tls", "mismatch"), ("spk/a.bsp", "ok")]
    (tmp_path / "k" / "b.tls").write_text("b")
    assert ephemeris.kernel_report(spark, *paths, str(tmp_path), library)["ready"]
    got = ephemeris.geometry_report(spark, paths[0], str(tmp_path), library)
    assert got["ready"] and got["geometry"]["phase_angle_deg"] == pytest.approx(90) and len(library.loaded) == 2


def test_geometry_commands_write_reports(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"observer": None, "spice": None}))
    (tmp_path / "m.json").write_text(json.dumps({"name": "n"}))
    common = ["--observation", str(tmp_path / "o.json"), "--root", str(tmp_path), "--out", str(tmp_path / "r.json")]
    assert cli.main(["spice-readiness", "--manifest", str(tmp_path / "m.json"), *common]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert not report["ready"] and "checksum_table_not_declared" in report["blocking_reasons"] and report["kernels"] == []
    assert cli.main(["spice-observation", *common]) == 0
    assert "missing_utc_start" in json.loads((tmp_path / "r.json").read_text())["blocking_reasons"]
