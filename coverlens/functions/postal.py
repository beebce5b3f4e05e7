"""Postal-code repair and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens import schema


def zip5(raw: Column) -> Column:
    """Five-character code: drop a '.0' tail or a '-' suffix, then restore leading zeros.

    Missing and redacted codes become NULL. Text that never was a code is padded or cut to five
    characters all the same; ``is_zip5`` tells whether the result is usable.
    """
    stem = (
        F.when(raw.endswith(".0"), F.substring_index(raw, ".", 1))
        .when(raw.contains("-"), F.substring_index(raw, "-", 1))
        .otherwise(raw)
    )
    return F.when(~raw.isin(*schema.UNKNOWN_TEXT), F.lpad(stem, 5, "0"))


def is_zip5(code: Column) -> Column:
    return code.rlike(schema.ZIP_PATTERNS["five"])


def zip_format(raw: Column) -> Column:
    """Which of the known shapes a raw code arrived in."""
    shapes = [
        (raw.isin(*schema.UNKNOWN_TEXT), schema.ZIP_MISSING),
        (is_zip5(raw), schema.ZIP_CLEAN),
        (raw.endswith(".0"), schema.ZIP_FLOAT),
        (raw.rlike(schema.ZIP_PATTERNS["four"]), schema.ZIP_SHORT),
        (raw.rlike(schema.ZIP_PATTERNS["plus4"]), schema.ZIP_PLUS4),
    ]
    label = F.lit(schema.ZIP_OTHER)
    for test, name in reversed(shapes):
        label = F.when(test, name).otherwise(label)
    return label
