"""Regions of interest from manifests to reprojected rasters: validation, readiness, download plans, extraction, reprojection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import text
from stillwater.operators import datasets, pixel, rank
from stillwater.plans import render
from stillwater.sources import labels, raster

DOCUMENT = "name STRING, url STRING, local_path STRING, expected_max_bytes BIGINT, purpose STRING"
PRODUCT = "name STRING, url STRING, local_path STRING, checksum STRING, expected_size_bytes BIGINT, label_url STRING, label_local_path STRING, purpose STRING"


def struct(fields: str) -> str:
    """A field list as a struct type."""
    return "STRUCT<" + ", ".join(": ".join(f.split(" ")) for f in fields.split(", ")) + ">"


#: The texts that a manifest must have.
REQUIRED = ("name", "source", "version", "expected_size", "local_destination", "license", "provenance", "resolution", "coordinate_system")
MANIFEST = ", ".join(f"{c} STRING" for c in REQUIRED) + f", checksum STRING, notes STRING, metadata_documents ARRAY<{struct(DOCUMENT)}>, product_files ARRAY<{struct(PRODUCT)}>, _corrupt_record STRING"
ROI = "name STRING, description STRING, center_lat_deg DOUBLE, center_lon_deg DOUBLE, width_km DOUBLE, height_km DOUBLE, target_resolution_m_per_px DOUBLE, required_products ARRAY<STRUCT<role: STRING, manifest: STRING, required: BOOLEAN, notes: STRING>>"


def manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a manifest file with its path; a file that is no JSON has ``_corrupt_record``."""
    raw = spark.read.format("binaryFile").load(list(paths)).select(F.col("path"), F.decode("content", "UTF-8").alias("json"))
    return raw.select("path", F.from_json(F.regexp_replace("json", "^﻿", ""), MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m")).select("path", "m.*")


def sound_checksum(c: Column) -> Column:
    return c.isNull() | text.checksum_parts(c)[2]


def validation(rows: DataFrame) -> DataFrame:
    """path, is_valid, error, n_documents, n_products, status, source_error of every manifest; an unsound one is a row, not a failure.

    ``source_error`` tells of a source that is no http(s) address; ``is_valid`` does not depend on it.
    """
    files = F.coalesce("product_files", F.array().cast(f"array<{struct(PRODUCT)}>"))
    documents = F.coalesce("metadata_documents", F.array().cast(f"array<{struct(DOCUMENT)}>"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    bad_file = lambda p: blank(p["name"]) | ~text.web_address(p["url"]) | ~F.coalesce(text.relative_path(p["local_path"]), F.lit(False))
    error = datasets.chain(
        (F.col("_corrupt_record").isNotNull(), "not JSON"),
        *((blank(F.col(c)), f"missing {c}") for c in REQUIRED),
        (~text.relative_path(F.col("local_destination")), "local_destination is not below the root"),
        (~sound_checksum(F.col("checksum")), "unsound checksum"),
        (F.exists(files, lambda p: bad_file(p) | ~sound_checksum(p["checksum"]) | F.coalesce(p["expected_size_bytes"] <= 0, F.lit(False))), "unsound product file"),
        (F.exists(documents, lambda d: bad_file(d) | ~F.coalesce(d["expected_max_bytes"], F.lit(labels.MOST_BYTES)).between(1, labels.MOST_BYTES)), "unsound metadata document"),
    )
    all_known = (F.size(files) > 0) & F.forall(files, lambda p: p["checksum"].isNotNull())
    status = datasets.manifest_status(F.col("version"), F.col("license"), F.col("checksum"), all_known)
    return rows.select("path", error.isNull().alias("is_valid"), error.alias("error"), F.size(documents).alias("n_documents"), F.size(files).alias("n_products"), F.when(error.isNull(), status).alias("status"), F.when(~F.coalesce(text.web_address(F.col("source")), F.lit(False)), "source is no http(s) address").alias("source_error"))


def regions(spark: SparkSession, *paths: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(list(paths)).select(F.decode("content", "UTF-8").alias("json"))
    return raw.select(F.from_json("json", ROI, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def requirements(roi: DataFrame, declared: DataFrame) -> DataFrame:
    """One row a region, role and product file, by the manifest's path ending."""
    need = roi.select(F.col("name").alias("roi"), "center_lat_deg", "center_lon_deg", "width_km", "height_km", "target_resolution_m_per_px", F.posexplode("required_products").alias("ordinal", "p"))
    need = need.select("*", "p.role", F.coalesce("p.required", F.lit(True)).alias("is_required"), F.regexp_extract("p.manifest", "([^/]+)$", 1).alias("file")).drop("p")
    all_known = (F.size(F.coalesce("product_files", F.array())) > 0) & F.forall("product_files", lambda p: p["checksum"].isNotNull())
    have = declared.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), datasets.manifest_status(F.col("version"), F.col("license"), F.col("checksum"), all_known).alias("manifest_status"), F.explode_outer("product_files").alias("f"))
    return need.join(have, "file", "left").select("*", F.col("f.local_path").alias("path"), F.col("f.url").alias("url"), F.col("f.checksum").alias("checksum"), F.col("f.expected_size_bytes").alias("expected_size"), F.col("f.label_url").alias("label_url"), F.col("f.label_local_path").alias("label_path")).drop("f")


def local_files(spark: SparkSession, root: str) -> DataFrame:
    """path below the root, size and content of the files there; content is only read where a plan digests it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.regexp_extract("path", f"{root.rstrip('/')}/(.*)$", 1).alias("path"), F.lit(True).alias("is_file"), F.col("length").alias("size"), "content")


def directory_size(spark: SparkSession, root: str) -> int:
    """Bytes of all files below a folder; none are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("length")
    return raw.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def file_statuses(needed: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each needed file with what is there and what its label says; ``parsed`` is ``labels.parsed`` with paths below the root."""
    f = lambda n: F.element_at("fields", n)
    number = lambda n: f(n).try_cast("double")
    names = ("minimum_latitude", "maximum_latitude", "westernmost_longitude", "easternmost_longitude", "map_scale", "lines", "line_samples", "array_offset_bytes")
    said = parsed.select(F.col("path").alias("label_path"), *(number(n).alias(n) for n in names), f("sample_type").alias("sample_type"), f("missing_constant").alias("missing_constant"), f("product_file_name").alias("labelled_file"), f("product_md5_checksum").alias("label_md5"), f("product_file_size_bytes").try_cast("long").alias("label_size"), F.lit(True).alias("has_label"))
    rows = needed.join(said, "label_path", "left")
    describes = F.lower(F.regexp_extract("path", "([^/]+)$", 1)) == F.lower("labelled_file")
    rows = rows.withColumn("describes_product", F.coalesce(describes, F.col("labelled_file").isNull()))
    # a label's own size and checksum stand in for undeclared ones, if it is this file that it describes
    rows = rows.withColumns({"checksum": F.coalesce("checksum", F.when(describes, F.concat(F.lit("md5:"), F.col("label_md5")))), "expected_size": F.coalesce("expected_size", F.when(describes, F.col("label_size")))})
    rows = datasets.with_files(rows, files, "path")
    bounds = {n: F.col(n) for n in names}
    cover = datasets.coverage(F.col("center_lat_deg"), F.col("center_lon_deg"), bounds)
    fits = datasets.resolution(F.col("map_scale"), F.col("target_resolution_m_per_px"))
    status = F.when(F.col("label_path").isNull(), "not_declared").when(F.col("has_label").isNull(), "missing").when((cover == "outside") | (fits == "coarser_than_target"), "incompatible").when((cover == "ok") & (fits == "ok"), "ok").otherwise("unknown")
    rows = rows.withColumns({"label_status": status, "coverage": cover, "resolution": fits})
    window = datasets.pixel_window(rows, F.col("center_lat_deg"), F.col("center_lon_deg"), F.col("width_km"), F.col("height_km"), bounds)
    return window.withColumnRenamed("status", "window_status")


def readiness(statuses: DataFrame) -> DataFrame:
    """roi, blocking roles and is_ready."""
    roles = statuses.groupBy("roi", "role").agg(F.bool_or("is_required").alias("is_required"), datasets.presence().alias("presence"), datasets.checksum_of_set().alias("checksum_status"), datasets.label_of_set().alias("label_status"), F.first("manifest_status").alias("manifest_status"))
    return datasets.readiness(roles.fillna({"manifest_status": "candidate"}), ["roi"])


def download_plan(statuses: DataFrame) -> DataFrame:
    """Labels and products that are not there, each destination once, in the order of the roles."""
    product = statuses.filter("presence <> 'present' AND url IS NOT NULL").select("roi", "ordinal", F.lit("product").alias("kind"), "url", F.col("path").alias("destination"), "expected_size", "checksum")
    label = statuses.filter("label_status = 'missing' AND label_url IS NOT NULL").select("roi", "ordinal", F.lit("label").alias("kind"), F.col("label_url").alias("url"), F.col("label_path").alias("destination"), F.lit(None).cast("long").alias("expected_size"), F.lit(None).cast("string").alias("checksum"))
    return rank.first_kept(product.unionByName(label), ["roi", "destination"], "ordinal")


def extraction(spark: SparkSession, statuses: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (path, y, x, v) of what can be cut out, missing constants as NaN; and the files that cannot, with the reason."""
    good, bad = render.extracted(statuses, {c: F.col(c) for c in ("path", "presence", "checksum_status", "size_status", "label_status", "describes_product", "window_status", "sample_type")})
    out = None
    for row in good.select("path", "sample_type", "lines", "line_samples", "array_offset_bytes", "row_start", "row_stop", "col_start", "col_stop", "missing_constant").collect():  # a region's few products
        if not (0 <= row["row_start"] <= row["row_stop"] <= row["lines"] and 0 <= row["col_start"] <= row["col_stop"] <= row["line_samples"]):
            raise ValueError(f"the window lies outside the labelled array of {row['path']}")
        cut = raster.load(spark, f"{root}/{row['path']}", sample_type=row["sample_type"], line_samples=int(row["line_samples"]), offset=int(row["array_offset_bytes"] or 0), **{k: row[k] for k in ("row_start", "row_stop", "col_start", "col_stop")})
        cut = pixel.masked(cut, F.lit(row["missing_constant"])).withColumn("path", F.lit(row["path"]))
        out = cut if out is None else out.unionByName(cut)
    return out if out is not None else spark.createDataFrame([], "y int, x int, v double, path string"), bad


def labels_below(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Parsed labels of a folder, by their paths below the root."""
    parsed = labels.parsed(labels.files(spark, f"{root}/{folder}"))
    return parsed.withColumn("path", F.regexp_extract("path", f"{root.rstrip('/')}/(.*)$", 1))
