"""Scalar rules on contest, code and text columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutframe import fixed_values as fv


# --- codes and names -------------------------------------------------------
def literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant map column; for the fixed code lists only (a few dozen keys)."""
    return F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])


def lookup_or_null(value: Column, pairs: Mapping[str, str]) -> Column:
    return F.try_element_at(literal_map(pairs), value)


def lookup_or_keep(value: Column, pairs: Mapping[str, str]) -> Column:
    return F.coalesce(lookup_or_null(value, pairs), value)


def standard_code(code: Column) -> Column:
    """Box-score spelling to standard code, exact match, unknown codes kept."""
    return lookup_or_keep(code, dict(zip(fv.BOXSCORE_CODES, fv.STANDARD_CODES)))


RATING_CODE_MAP = dict(zip(fv.RATING_CODES, fv.STANDARD_CODES))
# Later entries win: aliases over standard codes over the rating spellings.
ANY_CODE_MAP = {**RATING_CODE_MAP, **{c: c for c in fv.STANDARD_CODES}, **fv.CODE_ALIASES}


def any_standard_code(code: Column) -> Column:
    """Any known spelling to standard code after trimming, unknown codes kept."""
    return lookup_or_keep(F.trim(code), ANY_CODE_MAP)


def rating_code(code: Column) -> Column:
    """Rating spelling to standard code, unknown codes to null."""
    return lookup_or_null(code, RATING_CODE_MAP)


def place_code(place: Column) -> Column:
    return lookup_or_keep(place, fv.PLACE_CODES)


def modern_name(name: Column) -> Column:
    return lookup_or_keep(name, fv.MODERN_NAMES)


def strip_record(label: Column) -> Column:
    """``New England (10-3-1)`` to ``New England``."""
    return F.regexp_replace(label, fv.RECORD_SUFFIX, "")


# --- numbers and times -----------------------------------------------------
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_or_zero(text: Column) -> Column:
    """A decimal number as a double; any other text, and what is beyond doubles, as 0.0."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0))


def clock_seconds(clock: Column) -> Column:
    """``MM:SS`` to seconds; unreadable text to null."""
    parts = F.split(clock, ":")
    minutes = F.try_element_at(parts, F.lit(1)).try_cast("double")
    seconds = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return minutes * 60 + seconds


def guarded_rate(part: Column, whole: Column, default: float) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(default))


# --- outcomes --------------------------------------------------------------
def played(own: Column, other: Column) -> Column:
    return own.isNotNull() & other.isNotNull()


def outcome(own: Column, other: Column) -> Column:
    """1 for a win, 0.5 for a tie, 0 for a loss, null unless both scores are known."""
    return F.when(own > other, 1.0).when(own == other, 0.5).when(own < other, 0.0)


def prediction_line(
    season: Column, week: Column, away: Column, home: Column, away_probability: Column
) -> Column:
    """One padded text line per contest with both win chances in percent."""

    def percent(share: Column) -> Column:
        return F.concat(F.bround(share * 100, 2).cast("string"), F.lit("%)"))

    return F.format_string(
        "Season: %d %-7s: %-21s (%-8s at %-21s (%-8s",
        season,
        F.concat(F.lit("Week "), week.cast("string")),
        away,
        percent(away_probability),
        home,
        percent(F.lit(1.0) - away_probability),
    )
