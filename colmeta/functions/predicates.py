"""Tests of text values: what counts as blank, as a number, as a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What float() of Python accepts after the decimal comma became a point (ASCII digits), spaces around it.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER = rf"^[ \t\n\x0B\f\r]*+[+-]?(?:(?:{_DIGITS}[.,]?(?:{_DIGITS})?|[.,]{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?|nan))[ \t\n\x0B\f\r]*+$"
WHITE = r"^[ \t\n\x0B\f\r]*$"
#: Date formats by the shape of the values that they fit. Two-part dates need a year of four digits.
DATE_FORMATS = {
    r":.*T|T.*:": ("y-M-d'T'H:m[:s[.SSSSSS]][XXX]",),
    r":": ("y-M-d H:m[:s[.SSSSSS]][XXX]",),
    r"[A-Za-z]": ("d-MMM-y", "MMM-yyyy"),
    r"^\d+-\d+-": ("y-M-d", "M-d-y", "d-M-y"),
    r"^\d+/\d+/": ("y/M/d", "M/d/y", "d/M/y"),
    r"^\d+\.\d+\.": ("y.M.d", "M.d.y", "d.M.y"),
    r"-": ("yyyy-M", "M-yyyy"),
    r"/": ("yyyy/M", "M/yyyy"),
}
#: Shape of a value that is worth trying as a date.
DATE_SHAPE = r"^(\d{1,4}[-/.](\d{1,2}|[A-Za-z]{3})[-/.]\d{1,4}([ T]\d{1,2}:\d{1,2}.*)?|\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{4}|[A-Za-z]{3}-\d{4})$"
#: Words for a missing value in delimited files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TYPES = ("string", "numeric", "date")


def stripped(value: Column) -> Column:
    """The value as text without ASCII white space around it."""
    return F.trim(value.cast("string"), F.lit(" \t\n\v\f\r"))


def is_blank(value: Column) -> Column:
    """Null or the empty text; white space is not blank."""
    return value.isNull() | (value == "")


def is_number(value: Column) -> Column:
    """Whether a text is a number, with a point or a comma, white space around it or not."""
    return value.rlike(NUMBER)


def is_white(value: Column) -> Column:
    """Whether a text has nothing but ASCII white space."""
    return value.rlike(WHITE)


def is_date(value: Column) -> Column:
    """Whether a trimmed text is a date in one of DATE_FORMATS. Only the formats of the value's shape are tried."""
    fits = F.when(~value.rlike(DATE_SHAPE), False)
    for shape, formats in DATE_FORMATS.items():
        fits = fits.when(value.rlike(shape), F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in formats)).isNotNull())
    return F.coalesce(fits.otherwise(False), F.lit(False))


def without_na(value: Column) -> Column:
    """Null for the words that mean a missing value."""
    return F.when(~value.isin(*NA_TOKENS), value)


def type_label(total: Column, numbers: Column, dates: Column, threshold: float = 0.8) -> Column:
    """numeric or date if that many of the values are; else, or without values, string. Numbers are tested first."""
    return F.when((total > 0) & (numbers >= threshold * total), "numeric").when((total > 0) & (dates >= threshold * total), "date").otherwise("string")


def valid_type(label: Column) -> Column:
    """The label if it is one of TYPES, else string."""
    return F.when(label.isin(*TYPES), label).otherwise("string")
