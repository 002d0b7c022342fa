"""Formatting and parsing of submitted or displayed text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskcohort import constants as K

# Text accepted as a number, and the words for non-finite numbers.
NUMBER_PATTERN = (
    r"^[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
# Bare NaN and Infinity tokens of a JSON body arrive in double quotes.
NON_FINITE_PATTERN = r'(?i)^"?[+-]?(nan|inf|infinity)"?$'
BLANKS = " \t\n\r\x0b\x0c"
MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_number_text(c: Column) -> Column:
    return trimmed(c).rlike(NUMBER_PATTERN)


def is_non_finite_text(c: Column) -> Column:
    return trimmed(c).rlike(NON_FINITE_PATTERN)


def to_number(c: Column) -> Column:
    """Double from text that is plainly a number; NULL otherwise."""
    return F.when(is_number_text(c), F.replace(trimmed(c), F.lit("_"), F.lit("")).try_cast("double"))


def escape_markup(c: Column) -> Column:
    out = c
    for plain, escaped in MARKUP:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def percent(p: Column, digits: int) -> Column:
    return F.round(p * 100.0, digits)


def with_unit(c: Column, unit: str, digits: int | None = None) -> Column:
    """Value followed by its unit, or the fixed "not provided" text."""
    shown = c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c)
    return F.when(c.isNotNull(), F.concat(shown, F.lit(unit))).otherwise(K.NOT_PROVIDED)


def shown_details(details: Column) -> Column:
    """Drop laboratory entries that only say "not provided" from a label -> value map."""
    return F.map_filter(
        details,
        lambda k, v: ~(k.isin("HbA1c", "Fasting Glucose") & (v == K.NOT_PROVIDED)),
    )


def meter_zone(p: Column) -> Column:
    return F.when(p < 0.3, "low").when(p < 0.7, "middle").otherwise("high")


def record_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, h:mm a")
