"""Column expressions: pure ``Column -> Column`` helpers, all evaluated inside the JVM."""

from coverlens.functions.coding import (
    between_half_open,
    blank,
    decode,
    size_band,
    likely_community_solar,
    named,
    since,
    size_band_strict,
    tri_state,
)
from coverlens.functions.numeric import round_to, safe_ratio, share
from coverlens.functions.postal import zip5, zip_format
from coverlens.functions.temporal import month_number, months_apart, year_of

__all__ = [
    "between_half_open",
    "blank",
    "decode",
    "likely_community_solar",
    "month_number",
    "months_apart",
    "named",
    "round_to",
    "safe_ratio",
    "share",
    "since",
    "size_band",
    "size_band_strict",
    "tri_state",
    "year_of",
    "zip5",
    "zip_format",
]
