"""Sexagesimal parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"


def _three_parts(text: Column) -> list[Column]:
    parts = F.split(F.trim(text), ":")
    return [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)]


def hms_to_deg(text: Column) -> Column:
    """'11:11:31.67' -> degrees; NULL when malformed."""
    h, m, s = _three_parts(text)
    return (h + m / 60.0 + s / 3600.0) * 15.0


def dms_to_deg(text: Column) -> Column:
    """'-61:21:46.8' -> degrees, sign from the leading '-'; NULL when malformed."""
    t = F.trim(text)
    d, m, s = _three_parts(F.regexp_replace(t, r"^[+-]", ""))
    return F.when(t.startswith("-"), -1.0).otherwise(1.0) * (d + m / 60.0 + s / 3600.0)


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _hours(ra: Column) -> Column:
    return F.pmod(F.pmod(ra, F.lit(360.0)) + 360.0, F.lit(360.0)) / 15.0


def _split_seconds(x: Column) -> tuple[Column, Column, Column]:
    """Whole units, minutes and rounded seconds with carry."""
    whole = F.floor(x)
    minutes = F.floor((x - whole) * 60.0)
    secs = F.floor(((x - whole) * 60.0 - minutes) * 60.0 + 0.5)
    carry_s = F.when(secs >= 60, 1).otherwise(0)
    minutes2 = minutes + carry_s
    carry_m = F.when(minutes2 >= 60, 1).otherwise(0)
    return whole + carry_m, minutes2 - 60 * carry_m, secs - 60 * carry_s


def _split_minutes(x: Column) -> tuple[Column, Column]:
    whole = F.floor(x)
    minutes = F.floor((x - whole) * 60.0 + 0.5)
    carry = F.when(minutes >= 60, 1).otherwise(0)
    return whole + carry, minutes - 60 * carry


def format_ra_hms(ra: Column) -> Column:
    h, m, s = _split_seconds(_hours(ra))
    return F.concat(_pad(h % 24), F.lit("h"), _pad(m), F.lit("m"), _pad(s), F.lit("s"))


def _sign(dec: Column) -> Column:
    return F.when(dec < 0, MINUS).otherwise("+")


def format_dec_dms(dec: Column) -> Column:
    d, m, s = _split_seconds(F.abs(dec))
    return F.concat(_sign(dec), d.cast("string"), F.lit("°"), _pad(m), F.lit("′"), _pad(s), F.lit("″"))


def format_coord(ra: Column, dec: Column) -> Column:
    return F.concat(F.lit("RA "), format_ra_hms(ra), F.lit(" · Dec "), format_dec_dms(dec))


def format_ra_hm(ra: Column) -> Column:
    h, m = _split_minutes(_hours(ra))
    return F.concat(_pad(h % 24), F.lit("h"), _pad(m), F.lit("m"))


def format_dec_dm(dec: Column) -> Column:
    d, m = _split_minutes(F.abs(dec))
    return F.concat(_sign(dec), d.cast("string"), F.lit("°"), _pad(m), F.lit("′"))
