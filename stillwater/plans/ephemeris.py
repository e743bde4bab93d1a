"""Observation geometry from an ephemeris, and whether its kernels are ready.

An ephemeris library (optional, not required here) gives three vectors and a rotation for each observation; everything
that follows from them is column algebra, so that any number of observations is one plan.
"""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import geometry, text
from stillwater.operators import datasets
from stillwater.plans import products

MOON_RADIUS_KM = 1737.4
NEEDED = (("utc_start", "utc_start"), ("observer.latitude", "observer.latitude"), ("observer.longitude", "observer.longitude"), ("observer.altitude_m", "observer.altitude_m"))
OBSERVATION = "target STRING, utc_start STRING, observer STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude_m: DOUBLE>, telescope STRUCT<aperture_mm: DOUBLE, focal_length_mm: DOUBLE, central_obstruction: DOUBLE>, camera STRUCT<pixel_size_um: DOUBLE, width: INT, height: INT>, filter STRUCT<name: STRING, effective_wavelength_nm: DOUBLE>, spice STRUCT<kernels: ARRAY<STRING>>, earth_moon_distance_m DOUBLE"
VECTORS = "observation STRING, observer_km ARRAY<DOUBLE>, moon_km ARRAY<DOUBLE>, sun_from_moon_km ARRAY<DOUBLE>, moon_fixed ARRAY<DOUBLE>"


def observations(spark: SparkSession, *paths: str) -> DataFrame:
    """One row an observation file, with all parts it may lack."""
    raw = spark.read.format("binaryFile").load(list(paths)).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("json"))
    return raw.select("path", F.from_json("json", OBSERVATION, {"mode": "FAILFAST"}).alias("o")).select("path", "o.*")


def missing(rows: DataFrame) -> DataFrame:
    """path, reasons: what an observation lacks for its geometry."""
    parts = [F.when(F.col(c).isNull(), F.lit(f"missing_{name}")) for name, c in NEEDED]
    parts.append(F.when(F.size(F.coalesce("spice.kernels", F.array())) == 0, F.lit("missing_spice.kernels")))
    return rows.select("path", F.array_compact(F.array(*parts)).alias("reasons"))


def readiness(rows: DataFrame, files: DataFrame, table: DataFrame) -> DataFrame:
    """path, reasons (distinct, sorted), is_ready. ``files``: path and content of kernels there; ``table``: archive_path, md5."""
    named = rows.select(F.col("path").alias("observation"), F.explode("spice.kernels").alias("path"))
    there = named.join(files.select("path", "content"), "path", "left")
    statuses = datasets.kernel_statuses(there.select("path", "content").distinct(), table)
    bad = datasets.blocking_reasons(named.join(statuses, "path"), ["observation"]).withColumnRenamed("observation", "path")
    out = missing(rows).join(bad, "path", "left")
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", F.coalesce("blocking_reasons", F.array()))))
    return out.select("path", reasons.alias("reasons")).withColumn("is_ready", F.size("reasons") == 0)


def derived(vectors: DataFrame) -> DataFrame:
    """Distance, sizes, sub-observer and sub-solar points, phase and illuminated fraction from ``VECTORS`` rows."""
    v = lambda c: tuple(F.col(c)[i] for i in range(3))
    to_moon = geometry.minus(v("moon_km"), v("observer_km"))
    distance = geometry.required(geometry.norm(to_moon), "no distance to the Moon")
    to_observer = geometry.scaled(to_moon, F.lit(-1.0))
    turned = lambda a: tuple(sum((F.col("moon_fixed")[3 * i + j] * a[j] for j in range(3)), F.lit(0.0)) for i in range(3))
    sub_lat, sub_lon = geometry.latitude_longitude(turned(to_observer))
    sun_lat, sun_lon = geometry.latitude_longitude(turned(v("sun_from_moon_km")))
    phase = geometry.angle(to_observer, v("sun_from_moon_km"))
    return vectors.select(
        "observation",
        (distance * 1000.0).alias("earth_moon_distance_m"),
        F.degrees(F.asin(MOON_RADIUS_KM / distance)).alias("moon_angular_radius_deg"),
        sub_lat.alias("sub_observer_latitude_deg"),
        sub_lon.alias("sub_observer_longitude_deg_east"),
        sun_lat.alias("sub_solar_latitude_deg"),
        sun_lon.alias("sub_solar_longitude_deg_east"),
        phase.alias("phase_angle_deg"),
        geometry.illuminated(phase).alias("illuminated_fraction"),
    )


def vectors(rows: DataFrame, library) -> DataFrame:
    """``VECTORS`` rows of observations, by an ephemeris library with utc2et, pxform, spkpos, georec and bodvrd.

    Asked on the driver, an observation at a time: kernels are loaded into one process, and observations are few.
    """
    import numpy as np

    out = []
    for o in rows.collect():
        et = library.utc2et(o["utc_start"])
        try:
            radii = np.asarray(library.bodvrd("EARTH", "RADII", 3)[1], float)
        except Exception:  # a library without that constant
            radii = np.array([6378.1366, 6378.1366, 6356.7519])
        place = library.georec(np.radians(o["observer"]["longitude"]), np.radians(o["observer"]["latitude"]), o["observer"]["altitude_m"] / 1000.0, radii[0], (radii[0] - radii[2]) / radii[0])
        here = np.asarray(library.pxform("ITRF93", "J2000", et)) @ np.asarray(place)
        moon, sun = (np.asarray(library.spkpos(a, et, "J2000", "LT+S", b)[0], float) for a, b in (("MOON", "EARTH"), ("SUN", "MOON")))
        out.append((o["path"], here.tolist(), moon.tolist(), sun.tolist(), np.asarray(library.pxform("J2000", "MOON_ME", et), float).ravel().tolist()))
    return rows.sparkSession.createDataFrame(out, VECTORS)


LIBRARY = "spiceypy"


def installed():
    """The optional ephemeris library, or None."""
    try:
        return importlib.import_module(LIBRARY)
    except ModuleNotFoundError as missing_:
        if missing_.name == LIBRARY:
            return None
        raise


def declared(rows: DataFrame) -> list[str]:
    """The kernels that an observation names, each once."""
    return list(dict.fromkeys(k for r in rows.select("spice.kernels").collect() for k in r[0] or []))


def kernel_report(spark: SparkSession, observation: str, manifest: str, root: str, library=None) -> dict:
    """Whether an observation's kernels are there and sound by the manifest's checksum table. A kernel is read whole: below 2 GB each."""
    rows = observations(spark, observation)
    plan = products.manifests(spark, manifest).select("local_destination", "metadata_documents").first()
    tables = [d["local_path"] for d in plan["metadata_documents"] or [] if "checksum" in os.path.basename(d["local_path"]).lower()]
    tables.sort(key=lambda d: os.path.basename(d).lower() != "checksum.tab")
    place = os.path.join(root, tables[0]) if tables else None
    there = place is not None and os.path.exists(place)
    lines = spark.read.text(place).withColumn("line_no", F.monotonically_increasing_id()) if there else spark.createDataFrame([], "value string, line_no long")
    table = datasets.checksum_table(lines)
    counts = {r["kind"]: r["n"] for r in table.groupBy(text.kernel_type(F.col("archive_path")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a type
    known = {kind: n for kind, n in sorted(counts.items()) if kind != "unknown"}

    kernels, prefix = declared(rows), (plan["local_destination"] or "").rstrip("/") + "/"
    local = {k.replace("\\", "/").removeprefix(prefix): os.path.abspath(os.path.join(root, k)) for k in kernels}
    names = spark.createDataFrame(list(local.items()), "path string, local_path string")
    present = [p for p in local.values() if os.path.isfile(p)]
    files = spark.createDataFrame([], "local_path string, content binary")
    if present:
        files = spark.read.format("binaryFile").load(present).select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("local_path"), "content")
    held = names.join(files, "local_path", "left")
    statuses = datasets.kernel_statuses(held.select("path", "content"), table)
    listed = statuses.join(held.select("path", "local_path", F.md5("content").alias("computed_md5")), "path").join(table.withColumnRenamed("md5", "expected_md5"), "archive_path", "left").drop("path")

    status = "not_declared" if place is None else "missing" if not there else "ok" if counts else "empty"
    reasons = set(missing(rows).first()["reasons"]) | set(datasets.blocking_reasons(statuses).first()["blocking_reasons"])
    reasons |= {f"checksum_table_{status}"} - {"checksum_table_ok"}
    has_library = (library or installed()) is not None
    reasons |= set() if has_library else {f"{LIBRARY}_not_installed"}
    return {
        "observation": observation, "manifest": manifest, "cache_root": root, f"{LIBRARY}_available": has_library, "ready": not reasons, "blocking_reasons": sorted(reasons),
        "missing_observation_fields": [r.removeprefix("missing_") for r in missing(rows).first()["reasons"]],
        "checksum_table": {"path": place, "status": status, "entry_count": sum(counts.values()), "kernel_entry_count": sum(known.values()), "kernel_type_counts": known},
        "kernels": [r.asDict() for r in listed.orderBy("archive_path").collect()],
        "limitations": ["kernels are checked, no geometry is computed", "only kernels that the observation lists are looked at"],
    }


def geometry_report(spark: SparkSession, observation: str, root: str, library=None) -> dict:
    """The geometry of an observation from its local kernels, or why there is none."""
    rows, library = observations(spark, observation), library or installed()
    kernels = [os.path.join(root, k) for k in declared(rows)]
    reasons = set(missing(rows).first()["reasons"]) | ({"kernel_file_missing"} if not all(map(os.path.isfile, kernels)) else set())
    reasons |= {f"{LIBRARY}_not_installed"} if library is None else set()
    found = None
    if not reasons:
        try:
            for k in kernels:
                library.furnsh(k)
            found = derived(vectors(rows, library)).drop("observation").first().asDict()
        except Exception as error:  # the library's own errors have no common type
            reasons = {f"spice_geometry_error: {error}"}
        finally:
            if hasattr(library, "kclear"):
                library.kclear()
    return {"observation": observation, "cache_root": root, "ready": not reasons, "blocking_reasons": sorted(reasons), "kernels": kernels, "geometry": found, "limitations": ["geometry of the observation alone: no pixel is projected", "kernels are not downloaded"]}
