"""Interpretation of coded values: sentinels, flags, bands and date windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlens import schema


def blank(value: Column, *codes) -> Column:
    """NULL out sentinel ``codes``; every other value, 0 included, is kept."""
    return reduce(lambda c, code: F.nullif(c, F.lit(code)), codes, value)


def named(value: Column) -> Column:
    """True where a text field carries a real value (NULL stays NULL)."""
    return ~value.isin(*schema.UNKNOWN_TEXT)


def tri_state(flag: Column) -> Column:
    """1 -> TRUE, 0 -> FALSE, anything else -> NULL."""
    return F.when(flag.isin(0, 1), flag == 1)


def decode(flag: Column, labels: Mapping[int, str], otherwise: str) -> Column:
    """Text label of a coded flag; unlisted codes and NULL get ``otherwise``."""
    label = F.lit(otherwise)
    for code, text in labels.items():
        label = F.when(flag == code, text).otherwise(label)
    return label


def between_half_open(value: Column, low: float, high: float) -> Column:
    """``low <= value < high`` -- neighbouring ranges tile without overlap."""
    return (value >= F.lit(low)) & (value < F.lit(high))


def since(ts: Column, start: str) -> Column:
    """On or after an ISO date; comparable to a Parquet statistic, so it is pushed down."""
    return ts >= F.lit(start).cast("date")


def _ladder(value: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    band = F.lit(labels[-1])
    for cut, label in zip(reversed(cuts), reversed(labels[:-1])):
        band = F.when(value < F.lit(float(cut)), label).otherwise(band)
    return band


def size_band(
    value: Column,
    cuts: Sequence[float] = schema.SIZE_CUTS_KW,
    labels: Sequence[str] = schema.SIZE_LABELS,
) -> Column:
    """Half-open band label. NULL falls into the last band: filter to real sizes first."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("a ladder needs one label more than it has cuts")
    return _ladder(value, cuts, labels)


def size_band_strict(
    value: Column,
    cuts: Sequence[float] = schema.SIZE_CUTS_KW,
    labels: Sequence[str] = schema.SIZE_LABELS,
) -> Column:
    """Half-open band label with NULL -> NULL."""
    return F.when(value.isNotNull(), size_band(value, cuts, labels))


def likely_community_solar(segment: Column, kw: Column) -> Column:
    """A 'residential' record too large to be a rooftop. Reads the raw segment code."""
    return (segment == schema.RESIDENTIAL_SEGMENT) & (kw >= schema.COMMUNITY_MIN_KW)
