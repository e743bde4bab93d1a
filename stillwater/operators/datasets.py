"""Declared products against local files and labels: statuses, roll-ups, plans, windows and predicate chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.functions import geometry, text

Keys = Sequence[str]
#: Raster sample types that can be read, with their NumPy types.
SAMPLE_TYPES = {"IEEE754LSBSingle": "<f4", "SignedLSB2": "<i2"}


def chain(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule that holds, or null."""
    out = None
    for condition, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def checksum_status(declared: Column, present: Column, is_file: Column, actual: Column) -> Column:
    """not_declared, missing, not_file, ok or mismatch; ``actual`` is the digest by the declared algorithm."""
    expected = text.checksum_parts(declared)[1]
    return F.when(declared.isNull(), "not_declared").when(~present, "missing").when(~is_file, "not_file").when(F.lower(actual) == F.lower(expected), "ok").otherwise("mismatch")


def size_status(declared: Column, present: Column, is_file: Column, actual: Column) -> Column:
    return F.when(declared.isNull(), "not_declared").when(~present, "missing").when(~is_file, "not_file").when(actual == declared, "ok").otherwise("mismatch")


def with_files(declared: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """Declared files with what is there (files: path, is_file, size, content), by a left join."""
    rows = declared.join(files.withColumn("__there", F.lit(True)), on, "left")
    present, is_file = F.coalesce("__there", F.lit(False)), F.coalesce("is_file", F.lit(False))
    algorithm = text.checksum_parts(F.col("checksum"))[0]
    return rows.withColumns(
        {
            "presence": F.when(present, "present").otherwise("missing"),
            "checksum_status": checksum_status(F.col("checksum"), present, is_file, text.digest(F.col("content"), algorithm)),
            "size_status": size_status(F.col("expected_size"), present, is_file, F.col("size")),
        }
    ).drop("__there", "content")


def presence(status: str = "presence") -> Column:
    """Of a set of files: missing, present or partial."""
    there = F.count_if(F.col(status) == "present")
    return F.when(there == 0, "missing").when(there == F.count(F.lit(1)), "present").otherwise("partial")


def set_status(status: str, order: Sequence[str], good: str = "ok") -> Column:
    """Of a set of files: the first status of ``order`` that any has, ``good`` if all have it, else unknown."""
    out = None
    for s in order:
        hit = F.bool_or(F.col(status) == s)
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.when(F.bool_and(F.col(status) == good), good).otherwise("unknown")


def checksum_of_set(status: str = "checksum_status") -> Column:
    return set_status(status, ("mismatch", "not_file", "not_declared", "missing"))


def label_of_set(status: str = "label_status") -> Column:
    return set_status(status, ("incompatible", "ok", "missing", "not_declared"), "unknown")


def manifest_status(version: Column, license_: Column, checksum: Column, all_products: Column) -> Column:
    done = (checksum.isNotNull() | F.coalesce(all_products, F.lit(False))) & ~version.contains("TBD") & ~license_.contains("TBD")
    return F.when(done, "verified").otherwise("candidate")


def readiness(products: DataFrame, keys: Keys) -> DataFrame:
    """Blocking roles by reason and a flag; products: role, is_required, presence, checksum_status, manifest_status, label_status."""
    need = F.col("is_required")
    roles = lambda bad: F.array_sort(F.collect_list(F.when(need & bad, F.col("role"))))
    rows = products.groupBy(*keys).agg(
        roles(F.col("presence") != "present").alias("missing_required_roles"),
        roles(F.col("checksum_status") == "mismatch").alias("checksum_mismatch_roles"),
        roles(F.col("manifest_status") != "verified").alias("unresolved_checksum_roles"),
        roles(F.col("label_status") == "incompatible").alias("incompatible_metadata_roles"),
    )
    lists = [c for c in rows.columns if c not in keys]
    ready = F.lit(True)
    for c in lists:
        ready = ready & (F.size(c) == 0)
    return rows.withColumn("is_ready", ready)


def selected(declared: DataFrame, wanted: DataFrame, on: Keys) -> tuple[DataFrame, DataFrame]:
    """Declared rows that are wanted, and wanted ones that are not declared."""
    return declared.join(wanted, list(on), "left_semi"), wanted.join(declared, list(on), "left_anti")


def download_budget(downloads: DataFrame, keys: Keys, cap: int, size: str = "expected_size") -> DataFrame:
    return downloads.groupBy(*keys).agg(F.sum(size).alias("total_bytes"), F.count(F.lit(1)).alias("n_files")).withColumn("is_within", F.col("total_bytes") <= cap)


def coverage(lat: Column, lon: Column, fields: dict[str, Column]) -> Column:
    """unknown, ok or outside: whether a label's bounds hold a place."""
    low, high = fields["minimum_latitude"], fields["maximum_latitude"]
    west, east = geometry.longitude(fields["westernmost_longitude"]), geometry.longitude(fields["easternmost_longitude"])
    known = low.isNotNull() & high.isNotNull() & west.isNotNull() & east.isNotNull()
    inside = (lat >= F.least(low, high)) & (lat <= F.greatest(low, high)) & geometry.longitude_within(geometry.longitude(lon), west, east)
    return F.when(~known, "unknown").when(inside, "ok").otherwise("outside")


def resolution(scale: Column, target: Column) -> Column:
    return F.when(scale.isNull(), "unknown").when(scale <= target, "ok").otherwise("coarser_than_target")


def clamped(x: Column, top: Column) -> Column:
    return F.greatest(F.least(F.bround(x, 0), top), F.lit(0)).cast("int")


def pixel_window(rows: DataFrame, lat: Column, lon: Column, width_km: Column, height_km: Column, f: dict[str, Column]) -> DataFrame:
    """A region's rows and columns in a labelled raster; one map scale serves both axes."""
    lines, samples, scale = f["lines"], f["line_samples"], f["map_scale"]
    west, east = geometry.longitude(f["westernmost_longitude"]), geometry.longitude(f["easternmost_longitude"])
    lat_span, lon_span = F.abs(f["maximum_latitude"] - f["minimum_latitude"]), geometry.longitude_span(west, east)
    reason = chain(
        (lines.isNull() | samples.isNull() | scale.isNull() | lat_span.isNull() | lon_span.isNull(), "missing_label_fields"),
        ((lines <= 0) | (samples <= 0), "invalid_image_dimensions"),
        ((lat_span <= 0) | (lon_span <= 0), "invalid_map_bounds"),
    )
    fine = reason.isNull()
    safe = lambda c: F.when(fine, c)
    row = safe((F.greatest(f["maximum_latitude"], f["minimum_latitude"]) - lat) / F.when(lat_span > 0, lat_span) * lines)
    col = safe(geometry.longitude_offset(geometry.longitude(lon), west) / F.when(lon_span > 0, lon_span) * samples)
    half_h, half_w = (F.greatest(F.lit(1.0), km * 1000.0 / (2.0 * F.when(scale > 0, scale))) for km in (height_km, width_km))
    rows = rows.withColumns({"reason": reason, "status": F.when(reason.isNotNull(), "unknown").otherwise(coverage(lat, lon, f)), "row_start": clamped(row - half_h, lines), "row_stop": clamped(row + half_h, lines), "col_start": clamped(col - half_w, samples), "col_stop": clamped(col + half_w, samples)})
    return rows.withColumns({"row_stop": F.greatest("row_stop", "row_start"), "col_stop": F.greatest("col_stop", "col_start")})


def target_shape(km: Column, m_per_px: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(km * 1000.0 / m_per_px, 0).cast("int"))


def extraction_reason(r: dict[str, Column]) -> Column:
    """Why a file is not extracted; the first reason wins."""
    return chain(
        (~F.lower(r["path"]).rlike(r"\.img$"), "unsupported_file_type"),
        (r["presence"] != "present", "missing_product_file"),
        (r["checksum_status"] != "ok", F.concat(F.lit("checksum_"), r["checksum_status"])),
        (r["size_status"] != "ok", F.concat(F.lit("size_"), r["size_status"])),
        (r["label_status"] != "ok", F.concat(F.lit("label_"), r["label_status"])),
        (~r["describes_product"], "label_does_not_describe_product"),
        (r["window_status"] != "ok", F.concat(F.lit("window_"), r["window_status"])),
        (~F.coalesce(r["sample_type"].isin(*SAMPLE_TYPES), F.lit(False)), F.concat(F.lit("unsupported_sample_type_"), F.coalesce(r["sample_type"], F.lit("None")))),
    )


def reprojection_reason(output: Column, exists: Column, window: Column, scale: Column) -> Column:
    return chain((output.isNull(), "missing_extracted_output_path"), (~exists, "missing_extracted_array"), (window.isNull(), "missing_roi_pixel_window"), (scale.isNull(), "missing_source_map_scale"))


def kernel_statuses(kernels: DataFrame, table: DataFrame) -> DataFrame:
    """kernels: path, content (null if not there); table: archive_path, md5. One row a kernel with presence and checksum status."""
    rows = kernels.withColumns({"archive_path": text.archive_path(F.col("path")), "kernel_type": text.kernel_type(F.col("path"))}).join(table, "archive_path", "left")
    there = F.col("content").isNotNull()
    status = F.when(F.col("md5").isNull(), "not_in_checksum_table").when(~there, "missing").when(F.md5("content") == F.lower("md5"), "ok").otherwise("mismatch")
    return rows.select("path", "archive_path", "kernel_type", F.when(there, "present").otherwise("missing").alias("presence"), status.alias("checksum_status"))


def blocking_reasons(kernels: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distinct sorted reasons why kernels are not ready."""
    any_ = lambda c, name: F.when(F.bool_or(c), F.lit(name))
    return kernels.groupBy(*keys).agg(
        F.array_sort(F.array_compact(F.array(any_(F.col("presence") != "present", "kernel_file_missing"), any_(F.col("checksum_status") == "mismatch", "kernel_checksum_mismatch"), any_(F.col("checksum_status") == "not_in_checksum_table", "kernel_not_in_checksum_table")))).alias("blocking_reasons")
    )


def checksum_table(lines: DataFrame) -> DataFrame:
    """archive_path, md5 of lines (line_no, value) of two tokens; the last of a path wins."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line_no", parts.alias("p")).filter((F.size("p") == 2) & F.col("p")[0].rlike("^[0-9a-fA-F]{32}$"))
    rows = rows.select("line_no", F.lower(F.col("p")[0]).alias("md5"), text.archive_path(F.col("p")[1]).alias("archive_path"))
    return rows.groupBy("archive_path").agg(F.max_by("md5", "line_no").alias("md5"))


def limitations(spice_ready: Column, projected: Column, illuminated: Column, model: Column, mean_distance: Column) -> Column:
    """What a rendered reference is limited by, in report order."""
    sun = F.when(~illuminated, "no_illumination_model").when(model == "lommel_seeliger", "simple_lommel_seeliger_illumination_model").otherwise("simple_lambertian_illumination_model")
    return F.array_compact(
        F.array(
            F.when(spice_ready, "spice_libration_and_illumination_metadata_not_yet_applied_to_pixels").otherwise("not_spice_backed"),
            F.when(~spice_ready, F.lit("no_libration_or_orientation_solution")),
            F.when(projected, "local_linear_orthographic_projection").otherwise("not_earth_view_projected"),
            sun,
            F.when(mean_distance, F.lit("using_mean_earth_moon_distance")),
        )
    )
