"""Text to number, date and missing value, as column expressions."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Cell texts that mean "missing" when a CSV file is read.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The characters that Python's str.strip removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NUMBER_PATTERN = r"^(\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?(?i:inf|infinity))$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
INFINITY_PATTERN = r"(?i)inf"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although it is used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def number_or_null(text: Column) -> Column:
    """Text as double; anything that is not a plain decimal number is null.

    The pattern keeps out the Java forms (1d, 5f, 0x1p3) that a cast accepts.
    A finite text too large for a double is null, not infinity.
    """
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    overflow = number.isin(float("inf"), float("-inf")) & ~text.rlike(INFINITY_PATTERN)
    return F.when(~overflow, number)


def integer_or_null(text: Column) -> Column:
    """Text as bigint when it is written without point or exponent and fits."""
    return F.when(text.rlike(INTEGER_PATTERN), strip(text).try_cast("bigint"))


@dataclass(frozen=True)
class DateFormat:
    """A guard pattern and the Spark datetime pattern that go together."""

    guard: str
    pattern: str
    has_zone: bool = False


# Names in the guard patterns stand for the fields of a date.
_MONTHS_SHORT = "|".join(calendar.month_abbr[1:])
_MONTHS_LONG = "|".join(calendar.month_name[1:])
_DAY, _MONTH, _YEAR = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])", r"\d{4}"


def _date_parts() -> list[tuple[str, str]]:
    """(guard, pattern) of every date layout, most specific first."""
    parts = []
    for sep in ("-", "/", "."):
        esc = re.escape(sep)
        parts.append((f"{_YEAR}{esc}{_MONTH}{esc}{_DAY}", f"yyyy{sep}M{sep}d"))
    for sep in ("/", "-", "."):
        esc = re.escape(sep)
        parts.append((f"{_MONTH}{esc}{_DAY}{esc}{_YEAR}", f"M{sep}d{sep}yyyy"))
        parts.append((f"{_DAY}{esc}{_MONTH}{esc}{_YEAR}", f"d{sep}M{sep}yyyy"))
    parts.append((rf"{_YEAR}\d{{4}}", "yyyyMMdd"))
    # May is read as a full name, so a column that starts with it must go on so.
    for names, letters in ((_MONTHS_LONG, "MMMM"), (_MONTHS_SHORT, "MMM")):
        for sep in (" ", "-"):
            parts.append((f"{_DAY}{sep}(?i:{names}){sep}{_YEAR}", f"d{sep}{letters}{sep}yyyy"))
        parts.append((f"(?i:{names}) {_DAY}, {_YEAR}", f"{letters} d, yyyy"))
        parts.append((f"(?i:{names}) {_DAY} {_YEAR}", f"{letters} d yyyy"))
    parts.append((f"{_YEAR}-{_MONTH}", "yyyy-M"))
    parts.append((_YEAR, "yyyy"))
    return parts


def _time_parts() -> list[tuple[str, str, bool]]:
    """(guard, pattern, has zone) of every time layout that may follow a date."""
    hour, two = r"([01]?\d|2[0-3])", r"[0-5]?\d"
    clocks = [
        (f"{hour}:{two}", "H:m"),
        (f"{hour}:{two}:{two}", "H:m:s"),
        (rf"{hour}:{two}:{two}\.\d{{1,9}}", "H:m:s.SSSSSSSSS"),
    ]
    parts = [("", "", False)]
    for sep, quoted in ((" ", " "), ("[Tt]", "'T'")):
        for guard, pattern in clocks:
            parts.append((sep + guard, quoted + pattern, False))
            parts.append((sep + guard + r"(Z|[+-]\d{2}:\d{2})", quoted + pattern + "XXX", True))
    return parts


def date_formats() -> list[DateFormat]:
    clockless = ("yyyy-M", "yyyy")
    return [
        DateFormat(f"^{dg}{tg}$", dp + tp, zone)
        for dg, dp in _date_parts()
        for tg, tp, zone in _time_parts()
        if not (tg and dp in clockless)
    ]


def guess_date_format(sample: str | None) -> DateFormat | None:
    """The one layout that the first value of a column has, if it is known.

    Slash, dash and dot dates are read month first unless the first field can
    only be a day.
    """
    if sample is None:
        return None
    return next((f for f in date_formats() if re.match(f.guard, sample)), None)


def micros_to_timestamp(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without zone, whatever the session zone."""
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), _epoch())


def timestamp_micros(value: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", _epoch(), value.cast("timestamp_ntz"))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _parsed_micros(text: Column, fmt: DateFormat) -> Column:
    """Microseconds of a text in exactly this layout, else null; the text is read as UTC."""
    if fmt.has_zone:
        instant = F.try_to_timestamp(text, F.lit(fmt.pattern))
    else:
        instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(fmt.pattern + " Z"))
    return F.unix_micros(F.when(text.rlike(fmt.guard), instant))


def _in_nanosecond_range(micros: Column) -> Column:
    """Null for instants that a 64-bit nanosecond count cannot hold (before 1677, after 2262)."""
    return F.call_function("div", F.try_multiply(micros, F.lit(1000).cast("bigint")), F.lit(1000))


def parse_date(text: Column, fmt: DateFormat) -> Column:
    """Text in exactly this layout as a timestamp without zone, else null.

    It is rebuilt from its microseconds, so a wall-clock time that the session
    zone skips in spring is kept as written.
    """
    return micros_to_timestamp(_in_nanosecond_range(_parsed_micros(text, fmt)))


def free_formats() -> list[DateFormat]:
    """One layout per date part, with an optional clock time behind it."""
    clock = r"([ Tt]([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d(\.\d{1,9})?)?( [AaPp][Mm])?)?"
    optional = "[ h:m[:s] a][ H:m[:s[.SSSSSSSSS]]]['T'H:m[:s[.SSSSSSSSS]]]"
    return [DateFormat(f"^{guard}{clock}$", pattern + optional) for guard, pattern in _date_parts()]


SHORT_YEAR = r"^(\d{1,2}[-/.]\d{1,2}[-/.])(\d{2})( .*)?$"


def _with_century(text: Column) -> Column:
    """A date with a two-digit year in the century that is within 50 years of today."""
    this_century = F.lit(2000) + F.regexp_extract(text, SHORT_YEAR, 2).try_cast("int")
    year = F.when(this_century >= F.year(F.current_date()) + 50, this_century - 100).otherwise(this_century)
    full = F.concat(F.regexp_extract(text, SHORT_YEAR, 1), year.cast("string"), F.regexp_extract(text, SHORT_YEAR, 3))
    return F.when(text.rlike(SHORT_YEAR), full).otherwise(text)


def parse_any_date(text: Column) -> Column:
    """Each value on its own: the first known layout that fits it."""
    formats = free_formats()
    trimmed = strip(text)
    # One test tells the texts that no layout fits, which is most of them.
    fits = trimmed.rlike("|".join([SHORT_YEAR, *[f.guard for f in formats]]))
    tried = lambda spelled: F.coalesce(*[_parsed_micros(spelled, f) for f in formats])
    return micros_to_timestamp(_in_nanosecond_range(F.when(fits, let(_with_century(trimmed), tried))))


def nanos_to_timestamp(number: Column) -> Column:
    """A number as nanoseconds since 1970; digits below a microsecond are cut."""
    in_range = number.cast("double").between(-(2.0**63), 2.0**63 - 1024)
    nanos = F.when(in_range, number).cast("bigint")
    return micros_to_timestamp(F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000)))
