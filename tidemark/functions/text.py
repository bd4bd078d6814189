"""Column expressions that read numbers and dates written as text.

Every reader is a built-in expression: text that does not fit is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Numbers (fixed values) ------------------------------------------------
#: Non-breaking, narrow, thin and plain space: what locales group digits with.
GROUP_SPACES = "\u00a0\u202f\u2009 "
EDGES = " \t\r\n\"'`" + GROUP_SPACES
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "#N/A", "-")
_SIGNS = r"[\p{Sc}₠-₿" + GROUP_SPACES + "]*"
#: Hedge, bracket, sign, figures, unit, percent, bracket, trailing minus.
_NUMBER = (
    r"^(?i:(?:approx|about|ca)\.?\s*)?(\()?" + _SIGNS + r"([+-]?)" + _SIGNS
    + rf"(\d[\d.,{GROUP_SPACES}]*(?:[eE][+-]?\d+)?)" + _SIGNS
    + r"(?:[A-Za-z_/]+\.?)?" + _SIGNS + r"(%)?" + _SIGNS + r"(\))?(-)?$"
)
_MARK = "\u0001"
_EXPONENT = r"[eE][+-]?\d+$"
YEAR_NAME = r"(?i)(?:^|[^a-z])(?:year|yr|fy|jahr|ann[eé]e|anno|a[nñ]o|ejercicio)s?(?:[^a-z]|$)"
_BARE_YEAR = r"^(?:19|20)\d{2}$"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGES))


def number_parts(raw: Column) -> Column:
    """The figures of a written number and what stood around them, else null.

    One pattern takes the text apart; the figures lead, then a mark, then the
    bracket, percent and minus signs found.
    """
    parts = F.regexp_replace(_trim(raw), _NUMBER, f"$2$3{_MARK}$1$4$6")
    return F.when(parts.contains(_MARK), parts)


def number_core(parts: Column) -> Column:
    return F.translate(F.substring_index(parts, _MARK, 1), GROUP_SPACES, "")


def _around(parts: Column) -> Column:
    return F.substring_index(parts, _MARK, -1)


def is_negative(parts: Column) -> Column:
    return _around(parts).contains("(") | _around(parts).contains("-")


def is_percent(parts: Column) -> Column:
    return _around(parts).contains("%")


def separator_votes(core: Column) -> dict[str, Column]:
    """What a number's core says about its separators, each a condition."""
    plain = F.when(core.contains("e") | core.contains("E"), F.regexp_replace(core, _EXPONENT, "")).otherwise(core)
    comma, dot = core.contains(","), core.contains(".")
    later = F.length(F.substring_index(plain, ",", -1)) < F.length(F.substring_index(plain, ".", -1))

    def grouped(mark: str) -> Column:
        by_three = rf"^[+-]*\d{{1,3}}(?:(?:{mark}\d{{3}})+|(?:{mark}\d{{2}})+{mark}\d{{3}})$"
        return plain.rlike(by_three)

    def times(mark: str) -> Column:
        return F.length(core) - F.length(F.translate(core, mark, ""))

    return {
        "comma_last": comma & dot & later,
        "dot_last": comma & dot & ~later,
        "comma_only": comma & ~dot,
        "dot_only": dot & ~comma,
        "comma_grouped": F.when(comma & ~dot, grouped(",")),
        "dot_grouped": F.when(dot & ~comma, grouped(r"\.")),
        "bare_year": F.when(F.length(core) == 4, core.rlike(_BARE_YEAR)),
        "reads_point": times(".") <= 1,
        "reads_comma": times(",") <= 1,
    }


def number_value(raw: Column, decimal: str) -> Column:
    """The number a text writes, given the column's decimal mark."""
    return parts_value(number_parts(raw), decimal)


def parts_value(parts: Column, decimal: str) -> Column:
    """The number that ``number_parts`` took apart."""
    core = number_core(parts)
    plain = F.translate(core, ",.", ".") if decimal == "," else F.translate(core, ",", "")
    value = plain.try_cast("double")
    return F.when(is_negative(parts), -F.abs(value)).otherwise(value)


# ---- Dates (fixed values) --------------------------------------------------
MIN_YEAR, MAX_YEAR = 1900, 2100
EXCEL_EPOCH = "1899-12-30"
EXCEL_RANGE = (20_000, 60_000)
UNIX_RANGE = (315_532_800, 4_102_444_800)
_TIME = r"\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?"


@dataclass(frozen=True)
class Layout:
    """A way to write a date.

    Figures are turned round by ``pattern`` and ``order`` into year, month,
    day; layouts with a month's name are parsed by their ``named`` pattern.
    """

    label: str
    pattern: str = ""
    order: str = "$1-$2-$3"
    named: str = ""


#: Layouts that leave no doubt about day and month, in the order they are tried.
PLAIN_LAYOUTS = (
    Layout("YYYY-MM-DD", r"(\d{4})-(\d{1,2})-(\d{1,2})"),
    Layout("YYYY/MM/DD", r"(\d{4})/(\d{1,2})/(\d{1,2})"),
    Layout("YYYY.MM.DD", r"(\d{4})\.(\d{1,2})\.(\d{1,2})"),
    Layout("ISO timestamp", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T{_TIME}"),
    Layout("ISO timestamp", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}) {_TIME}"),
    Layout("YYYY-MM", r"(\d{4})-(\d{1,2})", "$1-$2-01"),
    Layout("YYYYMMDD", r"(\d{4})(\d{2})(\d{2})"),
    Layout("DD Mon YYYY", r"\d{1,2} [A-Za-z]{3} \d{4}", named="d MMM yyyy"),
    Layout("DD Month YYYY", r"\d{1,2} [A-Za-z]{3,9} \d{4}", named="d MMMM yyyy"),
    Layout("Mon DD, YYYY", r"[A-Za-z]{3} \d{1,2}, \d{4}", named="MMM d, yyyy"),
    Layout("Month DD, YYYY", r"[A-Za-z]{3,9} \d{1,2}, \d{4}", named="MMMM d, yyyy"),
    Layout("Mon DD YYYY", r"[A-Za-z]{3} \d{1,2} \d{4}", named="MMM d yyyy"),
    Layout("Mon YYYY", r"[A-Za-z]{3} \d{4}", named="MMM yyyy"),
    Layout("Month YYYY", r"[A-Za-z]{3,9} \d{4}", named="MMMM yyyy"),
)
#: A text that opens with a year, one that names a month: what either can be.
FIGURES = (
    rf"^\d{{4}}(?:-\d{{1,2}}(?:-\d{{1,2}}(?:[T ]{_TIME})?)?|/\d{{1,2}}/\d{{1,2}}|\.\d{{1,2}}\.\d{{1,2}}|\d{{4}})$"
)
NAMED = r"^(?:\d{1,2} [A-Za-z]{3,9} \d{4}|[A-Za-z]{3,9} (?:\d{1,2},? )?\d{4})$"
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
_SLASHED = tuple(
    rf"(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{{digits}}})" for digits in (4, 2) for mark in ("/", "-", r"\.")
)
SLASHED_SLOT = r"^\d{1,2}([/.\-])\d{1,2}\1(\d{4}|\d{2})$"
DAY_FIRST = tuple(Layout("DD/MM/YYYY", pattern, "$3-$2-$1") for pattern in _SLASHED)
MONTH_FIRST = tuple(Layout("MM/DD/YYYY", pattern, "$3-$1-$2") for pattern in _SLASHED)
TWO_PART = r"^\s*(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*\d{2,4}"
QUARTER = r"^\s*(\d{4})\s*[-/ ]?\s*[Qq]\s*([1-4])\s*$"
QUARTER_FIRST = r"^\s*[Qq]\s*([1-4])\s*[-/ ]?\s*(\d{4})\s*$"
ISO_WEEK = r"^\s*(\d{4})\s*[-/ ]?[Ww]\s*(\d{1,2})\s*$"
FISCAL = r"(?i)^\s*FY\s*(\d{4}|\d{2})\s*[-/ ]?\s*[PM]\s*(\d{1,2})\s*$"
_ZONED = r"^(.*\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:[Zz]|[+-]\d{2}:?\d{2})$"


def unzoned(text: Column) -> Column:
    """Drop a zone behind a time of day; the calendar day is kept, not shifted."""
    return F.when(text.contains(":"), F.regexp_replace(text, _ZONED, "$1")).otherwise(text)


def _digits(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def figures_reading(text: Column) -> Column:
    """Array with the (layout place, date) of a text that opens with a year."""
    mark = F.substring(text, 5, 1)
    dashed = (
        F.when(text.contains("T"), 3).when(text.contains(" "), 4).when(text.rlike(r"-.*-"), 0).otherwise(5)
    )
    place = F.when(mark == "-", dashed).when(mark == "/", 1).when(mark == ".", 2).otherwise(6)
    turned = F.regexp_replace(text, r"^(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{0,2}).*$", "$1-$2-$3")
    return F.array(_reading(place, F.rtrim(turned, F.lit("-")).try_cast("date")))


def named_readings(text: Column) -> Column:
    """Array of (layout place, date) of a text that names a month.

    A name of three letters and a full name are different layouts; May is both.
    """
    name = F.lower(F.regexp_extract(text, "[A-Za-z]+", 0))
    full = F.array(*[F.lit(month) for month in MONTH_NAMES])
    spelled = F.array_position(full, name)
    short = F.when(F.length(name) == 3, F.ceil(F.position(name, F.lit("".join(m[:3] for m in MONTH_NAMES))) / 3))
    figures = F.regexp_replace(text, r"^\D*?(?:(\d{1,2})\D+)?(\d{4})$", "$2~$1")
    year, day = F.substring(figures, 1, 4), F.substring_index(figures, "~", -1)
    day = F.when(day == "", F.lit("1")).otherwise(day)
    shape = F.when(text.rlike(r"^\d"), 7).when(text.contains(","), 9).when(text.rlike(" .* "), 11).otherwise(12)

    def dated(month: Column) -> Column:
        return F.when(month > 0, F.concat_ws("-", year, month.cast("string"), day)).try_cast("date")

    # "Mon DD YYYY" has no counterpart with the full name.
    return F.array(
        _reading(shape, dated(short)),
        _reading(shape + 1, F.when(~(shape == 11), dated(spelled))),
    )


def _reading(place: Column, day: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), day.alias("day"))


def slashed_readings(text: Column) -> Column:
    """Array of (layout place, date) for both readings of a 1/2/1999 text.

    The mark and the length of the year give the place of the layout, so two
    readings stand for all twelve.
    """
    mark = F.regexp_extract(text, SLASHED_SLOT, 1)
    long_year = F.length(F.regexp_extract(text, SLASHED_SLOT, 2)) == 4
    place = F.position(mark, F.lit("/-.")) - 1 + F.when(long_year, 0).otherwise(3)
    plain = F.translate(F.translate(text, ".", "/"), "-", "/")
    readings = []
    for base, layouts in ((len(PLAIN_LAYOUTS), DAY_FIRST), (len(PLAIN_LAYOUTS) + 6, MONTH_FIRST)):
        day = F.when(long_year, date_value(plain, layouts[0])).otherwise(date_value(plain, layouts[3]))
        readings.append(_reading(F.lit(base) + place, day))
    return F.array(*readings)


def _first_of(year: Column, month: int, day: int) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit(f"-{month}-{day}")).try_cast("date")


def _turned(text: Column, pattern: str, order: str) -> Column:
    # The mark in front keeps a text the pattern does not fit from reading as
    # a date of its own accord.
    marked = F.concat(F.lit("~"), text)
    return F.regexp_replace(marked, f"^~{pattern}$", order).try_cast("date")


def date_value(text: Column, layout: Layout) -> Column:
    """The date a text writes in one layout, else null."""
    if layout.named:
        shaped = F.when(text.rlike(f"^{layout.pattern}$"), text)
        return F.try_to_timestamp(shaped, F.lit(layout.named)).cast("date")
    if layout.pattern.endswith(r"(\d{2})") and layout.order.startswith("$3"):
        # Two-digit years from 69 belong to the last century.
        front = layout.pattern.removesuffix(r"(\d{2})")
        return F.coalesce(
            _turned(text, front + r"(69|[7-9]\d)", "19" + layout.order),
            _turned(text, front + r"([0-5]\d|6[0-8])", "20" + layout.order),
        )
    return _turned(text, layout.pattern, layout.order)


def _in_years(year: Column) -> Column:
    return year.between(MIN_YEAR, MAX_YEAR)


def quarter_value(text: Column) -> Column:
    turned = F.regexp_replace(F.regexp_replace(text, QUARTER_FIRST, "$2Q$1"), QUARTER, "$1Q$2")
    year, index = F.substring(turned, 1, 4).try_cast("int"), F.substring(turned, 6, 1).try_cast("int")
    month = (3 * index - 2).cast("string")
    opening = F.concat_ws("-", year.cast("string"), month, F.lit("1")).try_cast("date")
    return F.when(turned.rlike(r"^\d{4}Q[1-4]$") & _in_years(year), opening)


def iso_week_value(text: Column) -> Column:
    """Monday of an ISO week; a 53rd week the year does not have is null."""
    year, week = _digits(text, ISO_WEEK, 1), _digits(text, ISO_WEEK, 2)
    opening = F.trunc(_first_of(year, 1, 4), "week")
    monday = F.date_add(opening, 7 * (week - 1))
    fits = _in_years(year) & week.between(1, 53) & (F.year(F.date_add(monday, 3)) == year)
    return F.when(text.rlike(ISO_WEEK) & fits, monday)


def fiscal_value(text: Column, start_month: int = 1) -> Column:
    """First day of a fiscal period; the year runs on past December."""
    written = F.regexp_extract(text, FISCAL, 1)
    year = written.try_cast("int") + F.when(F.length(written) == 2, 2000).otherwise(0)
    period = _digits(text, FISCAL, 2)
    opening = _first_of(year, start_month, 1)
    fits = period.between(1, 12) & _in_years(year)
    return F.when(text.rlike(FISCAL) & fits, F.add_months(opening, period - 1))


def serial_value(number: Column) -> Column:
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), number.cast("int"))


def unix_value(number: Column) -> Column:
    return F.timestamp_seconds(number.cast("bigint")).cast("date")


NUMBER_IN_TEXT = r"-?\$?\d[\d,]*\.?\d*[%KMB]?"


def numbers_in(text: Column) -> Column:
    """The distinct numbers a text names, sorted, without a trailing full stop."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER_IN_TEXT})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.rtrim(n, F.lit(".")))))


def numbers_preserved(original: Column, rewritten: Column) -> Column:
    return numbers_in(original) == numbers_in(rewritten)


def without_null_tokens(text: Column) -> Column:
    return F.when(~F.trim(text).isin(*NULL_TOKENS), text)
