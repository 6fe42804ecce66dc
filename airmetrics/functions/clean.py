"""Column expressions for cleaning raw on-time records.

Everything here returns a ``Column`` built from native Spark functions, so the
conversions run inside whole-stage codegen; there is no Python UDF in the path.
Dirty input is handled with ``try_*`` functions under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts accepted by ``parse_fl_date``, tried in this order, each with the
# text shape it needs. ISO first, then compact ISO, then month-first ("general"
# parsing of US records), then date-time layouts (time dropped), then day-first.
# The shape test is a cheap regex; the parser (whose failures are costly) only
# sees strings of a matching shape.
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_COMPACT = r"^\d{8}$"
_SLASH = r"^\d{1,2}/\d{1,2}/\d{4}$"
_DASH = r"^\d{1,2}-\d{1,2}-\d{4}$"
_ISO_TIME = (r"^\d{4}-\d{2}-\d{2}[ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.]\d+)?)?"
             r" ?(Z|[+-]\d{2}:?\d{2})?$")
_SLASH_TIME = r"^\d{1,2}/\d{1,2}/\d{4} \d"
_ISO_SLASH = r"^\d{4}/\d{1,2}/\d{1,2}$"
_SHORT_YEAR = r"^\d{1,2}/\d{1,2}/\d{2}$"
_MONTH_NAME = r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"
DATE_LAYOUTS = [  # (shape, pattern, what is parsed: the whole date, a date and time, the first ten characters)
    (_ISO, "yyyy-MM-dd", "date"),
    (_COMPACT, "yyyyMMdd", "date"),
    (_SLASH, "M/d/yyyy", "date"),
    (_DASH, "M-d-yyyy", "date"),
    (_ISO_TIME, "yyyy-MM-dd", "head"),
    (_SLASH_TIME, "M/d/yyyy h:mm:ss a", "time"),
    (_SLASH_TIME, "M/d/yyyy H:mm:ss", "time"),
    (_SLASH_TIME, "M/d/yyyy H:mm", "time"),
    (_ISO_SLASH, "yyyy/M/d", "date"),
    (_SHORT_YEAR, "M/d/yy", "short"),
    (_MONTH_NAME, "MMM d, yyyy", "date"),
    (_DASH, "d-M-yyyy", "date"),
    (_SLASH, "d/M/yyyy", "date"),
]
LAST_SHORT_YEAR = 2068  # two-digit years: 00-68 are 2000-2068, 69-99 are 1969-1999

SECONDS_PER_DAY = 86400
LAST_SECOND = SECONDS_PER_DAY - 1  # "2400" is stored as 23:59:59


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_number(col: Column | str) -> Column:
    """Text or number -> double; bad text, blank, NaN -> null."""
    v = _c(col).try_cast("double")
    return F.when(~F.isnan(v), v)


def to_bool(col: Column | str) -> Column:
    """Non-zero -> true, zero -> false, null / unreadable -> false."""
    v = _c(col).try_cast("double")
    return F.coalesce(v != F.lit(0.0), F.lit(False))


def hhmm_truncated(col: Column | str) -> Column:
    """C6 step 1: number or text -> HHMM as a whole number (``int(float(x))``:
    truncated toward zero); blanks, text, NaN and infinities -> null."""
    x = _c(col).try_cast("double")
    return F.when(F.abs(x) < F.lit(1.0e9), x.cast("long"))  # false for NaN and infinities


def seconds_from_hhmm(t: Column | str) -> Column:
    """C6 step 2: whole HHMM -> seconds of day. 2400 maps to 23:59:59; negative
    values, values above 2359 and minutes above 59 give null."""
    t = _c(t)
    minutes = t % 100
    seconds = (F.floor(t / 100) * 3600 + minutes * 60).cast("int")
    return (F.when(t == 2400, F.lit(LAST_SECOND))
             .when((t < 0) | (t > 2359) | (minutes > 59), F.lit(None).cast("int"))
             .otherwise(seconds))


def hhmm_to_seconds(col: Column | str) -> Column:
    """HHMM clock (number or text) -> seconds of day (int).

    ``int(float(x))`` semantics: the value is truncated toward zero, so 930.7 is
    09:30 and -0.5 is 00:00. 2400 maps to 23:59:59. Negative values, values above
    2359, minutes above 59, blanks, text, NaN and infinities give null.
    For many columns at once prefer the two steps in separate projections
    (see ``operators.modelling.build_flights``): the shared step is then computed once.
    """
    return seconds_from_hhmm(hhmm_truncated(col))


def seconds_to_hhmmss(col: Column | str) -> Column:
    """Seconds of day -> 'HH:mm:ss' text (output form of the clock columns)."""
    s = _c(col)
    return F.when(s.isNotNull(), F.format_string(
        "%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), (s % 60).cast("int")))


def hour_of_day(col: Column | str) -> Column:
    """Hour (0-23) of a seconds-of-day clock value."""
    return F.floor(_c(col) / 3600).cast("int")


def parse_iso_date(col: Column | str, fail: bool = True) -> Column:
    """C4: strict yyyy-MM-dd. Under ANSI mode a bad value fails the job; with ``fail=False``
    it is null, and so is a date of any other layout."""
    if fail:
        return F.to_date(_c(col), "yyyy-MM-dd")
    return F.when(_c(col).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(_c(col), "yyyy-MM-dd"))


def date_text(col: Column | str) -> Column:
    """C5 step 1: the trimmed text of a date value."""
    return F.trim(_c(col).cast("string"))


def parse_date_text(s: Column | str) -> Column:
    """C5 step 2: trimmed text -> date, trying ``DATE_LAYOUTS`` in order."""
    s = _c(s)
    candidates = []
    for shape, fmt, part in DATE_LAYOUTS:
        if part == "time":
            parsed = F.to_date(F.try_to_timestamp(s, F.lit(fmt)))
        else:
            parsed = F.try_to_date(F.substring(s, 1, 10) if part == "head" else s, fmt)
        if part == "short":
            parsed = F.when(F.year(parsed) > LAST_SHORT_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)
        candidates.append(F.when(s.rlike(shape), parsed))
    return F.coalesce(*candidates)


def parse_fl_date(col: Column | str) -> Column:
    """Many date layouts -> date; unparseable -> null; time part dropped.

    Order: ISO, compact ISO, month-first with '/' and '-', date-time layouts (ISO ones with
    optional seconds, fraction and zone), year-first with '/', two-digit years, month names,
    then day-first with '-' and '/' (so 03-04-2018 is 4 March, 13-04-2018 is 13 April).
    """
    return parse_date_text(date_text(col))


def route_label(origin: Column | str, dest: Column | str) -> Column:
    """'origin → dest' (U+2192 with spaces); null unless both ends are known."""
    o, d = _c(origin), _c(dest)
    return F.when(o.isNotNull() & d.isNotNull(),
                  F.concat_ws(" → ", o.cast("string"), d.cast("string")))
