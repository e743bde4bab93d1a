"""Label files: flat key-value text and XML, bounded in size, as one table of fields; and checksum tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.functions import text
from stillwater.operators import datasets

MOST_BYTES = 1_000_000
#: What each field is called in an XML label (local names, the last one counts).
XML_FIELDS = {
    "logical_identifier": "logical_identifier", "label_version_id": "version_id", "title": "title", "citation_description": "citation_desc",
    "product_creation_time": "modification_date", "publication_year": "publication_year", "doi": "doi", "map_projection_type": "map_projection_name",
    "minimum_latitude": "south_bounding_coordinate", "maximum_latitude": "north_bounding_coordinate", "westernmost_longitude": "west_bounding_coordinate",
    "easternmost_longitude": "east_bounding_coordinate", "map_scale": "pixel_scale_x", "product_file_name": "file_name",
    "product_file_size_bytes": "file_size", "product_md5_checksum": "md5_checksum",
}


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of label files; one over the size limit fails."""
    raw = spark.read.format("binaryFile").load(list(paths))
    fits = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("label too large: "), "path")).cast("binary"))
    return raw.select("path", F.decode(fits, "UTF-8").alias("text"))


def xml_values(path: str) -> Column:
    """The trimmed texts, none of them blank, at an XPath."""
    return F.filter(F.transform(F.expr(f'xpath(text, "{path}/text()")'), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")


def xml_field(name: str) -> Column:
    return F.try_element_at(xml_values(f"//*[local-name()='{name}']"), F.lit(-1))


def axis_size(axis: str) -> Column:
    """The last size given for an axis, in whatever structure."""
    named = "translate(normalize-space(*[local-name()='axis_name']), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return F.try_element_at(xml_values(f"//*[{named}='{axis}']/*[local-name()='elements']"), F.lit(-1))


def array_field(name: str) -> Column:
    """A value of the first two-dimensional array."""
    return F.try_element_at(xml_values(f"(//*[local-name()='Array_2D_Image'])[1]//*[local-name()='{name}']"), F.lit(1))


def xml_fields() -> dict[str, Column]:
    resolution = xml_field("pixel_resolution_x").try_cast("double")
    bits = xml_field("sample_bit_mask")
    return {name: xml_field(source) for name, source in XML_FIELDS.items()} | {
        "map_resolution": F.when(resolution > 0, (1 / resolution).cast("string")),
        "sample_bits": (F.length(bits) - F.length(F.replace(bits, F.lit("1"), F.lit("")))).cast("string"),
        "sample_type": F.coalesce(array_field("data_type"), xml_field("data_type")),
        "array_offset_bytes": array_field("offset"),
        "missing_constant": array_field("missing_constant"),
        "lines": axis_size("line"),
        "line_samples": axis_size("sample"),
    }


def parsed(labels: DataFrame) -> DataFrame:
    """path, fields (a map of lower-case names to bare values), whatever the label's form."""
    xml = labels.filter(F.ltrim("text").rlike(r"^<(\?xml|Product)"))
    flat = labels.filter(~F.ltrim("text").rlike(r"^<(\?xml|Product)"))
    fields = [x for name, value in xml_fields().items() for x in (F.lit(name), value)]
    from_xml = xml.select("path", F.map_filter(F.create_map(*fields), lambda k, v: v.isNotNull()).alias("fields"))
    from_flat = flat.select("path", F.transform_values(text.label_map(F.col("text")), lambda k, v: text.bare_value(v)).alias("fields"))
    return from_flat.unionByName(from_xml)


def summary(fields: DataFrame) -> DataFrame:
    """path, provenance (known ones alone) and the numbers that windows need."""
    f = lambda name: F.element_at("fields", name)
    known = F.map_filter("fields", lambda k, v: k.isin(*text.PROVENANCE_KEYS))
    numbers = ("minimum_latitude", "maximum_latitude", "westernmost_longitude", "easternmost_longitude", "map_scale", "map_resolution", "lines", "line_samples", "sample_bits", "product_file_size_bytes", "array_offset_bytes")
    return fields.select("path", known.alias("provenance"), f("map_projection_type").alias("projection"), *(f(n).try_cast("double").alias(n) for n in numbers), *(f(n).alias(n) for n in ("sample_type", "product_file_name", "product_md5_checksum", "missing_constant")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """archive_path, md5 of a checksum file; the last line of a path wins. (One small file: its lines are numbered in one task.)"""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return datasets.checksum_table(lines)
