"""What a product's path says: its sensor, its data level, whether it is safe to extract.

The three sensor classifiers differ on purpose: a path with two sensors is unknown to
the first, while the others take the first match in their own order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How product names of the three instruments are recognised.
PATH_PATTERNS = {
    "OHRC": r"(^|[^a-z])ohrc?([^a-z]|$)|ch2_ohr",
    "TMC-2": r"(^|[^a-z])tmc(?:-?2)?([^a-z]|$)|ch2_tmc",
    "IIRS": r"(^|[^a-z])iirs?([^a-z]|$)|ch2_iir",
}
ARCHIVE_PATTERNS = {
    "OHRC": r"(?:^|[^a-z0-9])(?:ohrc|ohr)(?:[^a-z0-9]|$)",
    "TMC-2": r"(?:^|[^a-z0-9])tmc(?:-?2)?(?:[^a-z0-9]|$)",
    "IIRS": r"(?:^|[^a-z0-9])(?:iirs|iir)(?:[^a-z0-9]|$)",
}
INVENTORY_PARTS = {"TMC-2": ("/tmc-2/", "tmc_"), "OHRC": ("/ohrc/", "ch2_ohr_", "ohrc"), "IIRS": ("/iirs/", "ch2_iir_", "iirs")}
LEVELS = ("calibrated", "processed", "derived", "raw")
IMAGE_SUFFIXES = (".img", ".tif", ".tiff", ".jp2", ".png", ".jpg", ".jpeg", ".qub")
SCIENCE_SUFFIXES = (".img", ".qub", ".jp2", ".tif", ".tiff")
QUICKLOOK_SUFFIXES = (".png", ".jpg", ".jpeg")


def sensor_of_path(path: Column) -> Column:
    """``struct(sensor, confidence, evidence)``; UNKNOWN for synthetic data, for conflicts and where nothing matches."""
    text = F.lower(path)
    synthetic = text.contains("synthetic") | F.array_contains(F.split(path, "/"), "sample")
    found = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(s)) for s, p in PATH_PATTERNS.items())))
    one = ~synthetic & (F.size(found) == 1)
    evidence = F.when(synthetic, "synthetic").when(one, "product identifier").when(F.size(found) > 1, "conflicting identifiers").otherwise("no identifier")
    return F.struct(F.when(one, F.get(found, F.lit(0))).otherwise("UNKNOWN").alias("sensor"), F.when(one, 1.0).otherwise(0.0).alias("confidence"), evidence.alias("evidence"))


def _first(cases: dict[str, Column]) -> Column:
    out = None
    for value, condition in cases.items():
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def sensor_of_archive(name: Column, members: Column) -> Column:
    """First sensor named by the archive or its first 100 members, else null."""
    text = F.lower(F.concat_ws(" ", name, F.slice(members, 1, 100)))
    return _first({s: text.rlike(p) for s, p in ARCHIVE_PATTERNS.items()})


def sensor_of_file(path: Column) -> Column:
    """First sensor whose folder or name part occurs in the path, else null."""
    text = F.lower(path)

    def any_of(parts):
        c = text.contains(parts[0])
        for p in parts[1:]:
            c = c | text.contains(p)
        return c

    return _first({s: any_of(p) for s, p in INVENTORY_PARTS.items()})


def data_level(paths: Column) -> Column:
    """The level named by a component of any of the paths, the most refined first."""
    parts = F.flatten(F.transform(paths, lambda p: F.split(F.lower(p), "/")))
    return F.coalesce(_first({level: F.array_contains(parts, level) for level in LEVELS}), F.lit("unknown"))


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """The path without its suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def is_safe_member(path: Column) -> Column:
    """Whether an archive member's name stays below the folder that it is extracted to."""
    return ~(path.contains("\x00") | path.contains("\\") | path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), ".."))
