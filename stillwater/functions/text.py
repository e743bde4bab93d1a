"""Label text, names, checksums and numbers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label keys that are read.
LABEL_KEYS = (
    "DATA_SET_ID", "EASTERNMOST_LONGITUDE", "INSTRUMENT_ID", "INSTRUMENT_NAME", "LINE_SAMPLES", "LINES",
    "MAP_PROJECTION_TYPE", "MAP_RESOLUTION", "MAP_SCALE", "MAXIMUM_LATITUDE", "MINIMUM_LATITUDE", "MISSION_NAME",
    "PRODUCER_ID", "PRODUCT_CREATION_TIME", "PRODUCT_ID", "SAMPLE_BITS", "SAMPLE_TYPE", "TARGET_NAME", "WESTERNMOST_LONGITUDE",
)
#: Label fields that say where a product comes from.
PROVENANCE_KEYS = (
    "product_id", "data_set_id", "logical_identifier", "label_version_id", "title", "citation_description", "publication_year",
    "doi", "producer_id", "product_creation_time", "mission_name", "instrument_name", "instrument_id", "target_name",
)
#: Kernel types by file suffix.
KERNEL_TYPES = {".bc": "ck", ".bsp": "spk", ".tf": "fk", ".ti": "ik", ".tls": "lsk", ".tpc": "pck", ".tsc": "sclk"}
#: The space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Letters whose capitals take more than one character, with the one character that stands for them or themselves; then
#: letters that have had capitals only since Unicode 16, which the SQL's engine does not know.
SINGLE_CAPITALS = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
SINGLE_CAPITALS |= {c: c for c in map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)))}
DIGESTS = ("md5", "sha1", "sha256")


def label_pairs(text: Column, keys: tuple[str, ...] | None = LABEL_KEYS) -> Column:
    """key, value of the ``KEY = value`` lines of a flat label, in order; ``keys`` None keeps every key."""
    lines = F.split(text, r"\r\n|\r|\n")
    bare = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"/\*.*?\*/", "")))
    pairs = F.transform(F.filter(bare, lambda s: s.contains("=")), lambda s: F.struct(F.upper(F.trim(F.split(s, "=", 2)[0])).alias("key"), F.trim(F.split(s, "=", 2)[1]).alias("value")))
    return pairs if keys is None else F.filter(pairs, lambda p: p["key"].isin(*keys))


def upper_singly(s: Column) -> Column:
    """Upper case, letter by letter: the text keeps its length, as in the SQL."""
    special = "".join(SINGLE_CAPITALS)
    capitals = F.create_map(*(F.lit(x) for kv in SINGLE_CAPITALS.items() for x in kv))
    pieces = F.split(s, f"(?<=[{special}])|(?=[{special}])")
    return F.when(s.rlike(f"[{special}]"), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(capitals, p), F.upper(p))), "")).otherwise(F.upper(s))


def line_pairs(text: Column) -> Column:
    """key, value of every line with an equals sign as it stands: comments and carriage returns are text."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.contains("="))
    bare = lambda s: F.btrim(s, F.lit(SPACES))
    return F.transform(lines, lambda s: F.struct(upper_singly(bare(F.substring_index(s, "=", 1))).alias("key"), bare(F.substring(s, F.instr(s, "=") + 1, F.length(s))).alias("value")))


def label_map(text: Column) -> Column:
    """The label as a map, the last value of a key winning."""
    pairs = label_pairs(text)
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(p["key"])), F.create_map(F.lower(p["key"]), p["value"])))


def bare_value(value: Column) -> Column:
    """A label value without a trailing comma, quotes or unit."""
    v = F.trim(F.regexp_replace(F.trim(value), r",$", ""))
    v = F.trim(F.regexp_replace(v, r"\s*<[^>]*>$", ""))
    return F.regexp_replace(v, r'^"(.*)"$', "$1")


def number(value: Column) -> Column:
    """The value as a double, or null if it is no number."""
    return bare_value(value).try_cast("double")


def kind_of(value: Column) -> Column:
    """How a value is read: list, real, integer or text."""
    v = bare_value(value)
    is_number = v.try_cast("double").isNotNull()
    return F.when(v.startswith("("), "list").when(is_number & v.rlike("[.eE]"), "real").when(v.try_cast("bigint").isNotNull() & v.rlike(r"^[+-]?[0-9]+$"), "integer").otherwise("text")


def bit_count(mask: Column) -> Column:
    return F.length(mask) - F.length(F.replace(mask, F.lit("1"), F.lit("")))


def safe_name(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def archive_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def kernel_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KERNEL_TYPES.items() for x in kv)), suffix), F.lit("unknown"))


def checksum_parts(s: Column) -> tuple[Column, Column, Column]:
    """Algorithm, hex and whether both are sound, of ``algorithm:hex``."""
    algorithm, rest = F.lower(F.substring_index(s, ":", 1)), F.substring(s, F.instr(s, ":") + 1, F.length(s))
    good = s.contains(":") & algorithm.isin(*DIGESTS) & rest.rlike("^[0-9A-Fa-f]+$")
    return algorithm, rest, good


def digest(content: Column, algorithm: Column) -> Column:
    return F.when(algorithm == "md5", F.md5(content)).when(algorithm == "sha1", F.sha1(content)).when(algorithm == "sha256", F.sha2(content, 256))


def relative_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root."""
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def web_address(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(False))


def json_number(v: Column) -> Column:
    """A number as JSON text, infinities and NaN as strings."""
    return F.when(F.isnan(v), '"nan"').when(v == float("inf"), '"inf"').when(v == float("-inf"), '"-inf"').otherwise(v.cast("string"))


def slug(x: float) -> str:
    """A number in a scenario's name."""
    return f"{x:g}".replace("-", "m").replace(".", "p")


def shown(x: float | None) -> str:
    """A number in a report."""
    return "n/a" if x is None else f"{x:.6g}" if math.isfinite(x) else str(x)
