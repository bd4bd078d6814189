"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds and suffixes of shortened numbers (fixed values).
SCALES = ((1e12, "T", 2), (1e9, "B", 2), (1e6, "M", 2), (1e3, "K", 1))


def compact(value: Column, symbol: str = "") -> Column:
    """1234567 as 1.23M; three figures below one; nothing for no number."""
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    out = F.format_number(F.bround(size, 0), 0)
    # Below one: as many places as leave three significant figures.
    places = 2 - F.floor(F.log10(size)).cast("int")
    shift = F.pow(F.lit(10.0), places.cast("double"))
    small = F.regexp_replace((F.round(size * shift) / shift).cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    out = F.when(size == 0, "0").when(size < 1, small).otherwise(out)
    for threshold, suffix, digits in reversed(SCALES):
        shown = F.format_string(f"%.{digits}f%s", F.round(size / threshold, digits), F.lit(suffix))
        out = F.when(size >= threshold, shown).otherwise(out)
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.concat(sign, F.lit(symbol), out))


def change_pct(now: Column, before: Column, digits: int = 2) -> Column:
    return F.when(before != 0, F.round((now - before) / F.abs(before) * 100, digits))
