"""Time helpers: bucket origin (F3), ISO parsing (F5) and formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from roverlake.functions.util import as_col

# ---------------------------------------------------------------------------
# Fixed values.
# Bucket origin of the reference's time_bucket for day/hour/minute widths:
#   2000-01-03 00:00:00 UTC, which is day 10959 after 1970-01-01.
# Bucket origin for month widths: 2000-01-01.
# ---------------------------------------------------------------------------
BUCKET_ORIGIN_DAYS = 10959
MONTH_ORIGIN = "2000-01-01"

_UNIT_SECONDS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400,
}
_INTERVAL = re.compile(r"^\s*(\d+)\s*([a-z]+?)s?\s*$", re.IGNORECASE)


def parse_width(interval: str) -> tuple[int, str]:
    """'15 minutes' -> (900, 'seconds'); '3 months' -> (3, 'months')."""
    m = _INTERVAL.match(interval)
    if not m:
        raise ValueError(f"cannot read interval {interval!r}")
    n, unit = int(m.group(1)), m.group(2).lower()
    if unit in ("month", "mon"):
        return n, "months"
    if unit in ("year",):
        return 12 * n, "months"
    unit = {"min": "minute", "sec": "second", "hr": "hour"}.get(unit, unit)
    if unit not in _UNIT_SECONDS:
        raise ValueError(f"unknown interval unit in {interval!r}")
    return n * _UNIT_SECONDS[unit], "seconds"


def time_bucket(ts, interval: str) -> Column:
    """Start of the bucket holding ``ts``, counted from the reference origin."""
    ts = as_col(ts)
    n, kind = parse_width(interval)
    if kind == "months":
        months = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
        start = F.add_months(F.lit(MONTH_ORIGIN).cast("date"), (F.floor(months / n) * n).cast("int"))
        return start.cast("timestamp_ntz")
    return time_window(ts, interval)["start"]


def time_window(ts, interval: str) -> Column:
    """The bucket of fixed width that holds ``ts`` as a window (start, end): a grouping
    that a watermark can close on a stream."""
    n, kind = parse_width(interval)
    if kind != "seconds":
        raise ValueError(f"bucket width {interval!r} has no fixed length")
    offset = (BUCKET_ORIGIN_DAYS * 86400) % n
    return F.window(as_col(ts), f"{n} seconds", f"{n} seconds", f"{offset} seconds")


# Fixed grammar of ISO 8601 texts: a calendar or week date, extended or basic, then
# any one separator and a time, extended or basic, with an optional offset.
_COMMON = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?)?$"
_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+|(?=[Z+-])))?)?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+|(?=[Z+-])))?)?)"
_OFFSET = r"(?:(Z)|([+-])(\d{2})(?::(\d{2})(?::(\d{2}))?|(\d{2})(\d{2})?)?)?"
_ISO = rf"^{_DATE}(?:[\s\S]{_CLOCK}{_OFFSET})?$"


def parse_iso(s) -> Column:
    """``datetime.fromisoformat`` on text (F5): NULL when it does not parse.

    The common form is cast directly; any other text must match the whole grammar
    and is put together from its fields (offsets of a day and more, week 53 of a
    short year, leap seconds and the like are refused; fractions are cut to
    microseconds).
    """
    s = as_col(s)
    # The fields of an uncommon text, in one pass; built inside a lambda, so that the
    # common path's generated code stays small.
    fields = F.split(F.regexp_replace(s, _ISO, "|".join(f"${g}" for g in range(1, 25))), r"\|")
    built = F.transform(F.array(fields), _from_fields)[0]
    return F.when(s.rlike(_COMMON), s.try_cast("timestamp")).when(s.rlike(_ISO), built)


def _from_fields(fields: Column) -> Column:
    """Time of the grammar's 24 groups; NULL if they are no time."""

    def number(*groups: int) -> Column:
        """The first group that matched."""
        return F.coalesce(*(F.nullif(fields[g - 1], F.lit("")) for g in groups))

    def whole(*groups: int) -> Column:
        return number(*groups).cast("int")

    zero = F.lit(0)
    year, week, day_of_week = whole(1), whole(6, 8), F.coalesce(whole(7, 9), F.lit(1))
    monday = F.date_trunc("week", F.try_make_timestamp(year, F.lit(1), F.lit(4), zero, zero, zero)).cast("date")
    weeks = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    week_ok = week.between(1, weeks) & day_of_week.between(1, 7)
    date = F.when(week.isNotNull(), F.when(week_ok, F.date_add(monday, (week - 1) * 7 + day_of_week - 1)))
    month, day = F.when(week.isNotNull(), F.month(date)).otherwise(whole(2, 4)), F.when(week.isNotNull(), F.day(date)).otherwise(whole(3, 5))
    calendar_year = F.when(week.isNotNull(), F.year(date)).otherwise(year)
    hour, minute, second = (F.coalesce(whole(*g), zero) for g in ((10, 14), (11, 15), (12, 16)))
    part = F.coalesce(F.rpad(F.substring(number(13, 17), 1, 6), 6, "0").cast("long"), F.lit(0))
    off_h, off_m, off_s = (F.coalesce(whole(*g), zero) for g in ((20,), (21, 23), (22, 24)))
    offset = (off_h * 3600 + off_m * 60 + off_s) * F.when(fields[18] == "-", -1).otherwise(1)
    sound = (year >= 1) & (second < 60) & (F.abs(offset) < 86400)
    start = F.try_make_timestamp(calendar_year, month, day, hour, minute, second)
    return F.when(sound, F.timestamp_micros(F.unix_micros(start) + part - offset.cast("long") * 1_000_000))


def iso_format(ts) -> Column:
    """Python ``isoformat()`` of a naive time: no fraction when it is zero."""
    ts = as_col(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
    )


def rfc3339(ts) -> Column:
    """RFC 3339 text without fraction."""
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def unix_seconds(ts) -> Column:
    """Whole seconds since the epoch, truncated (used by the deployment id, F19)."""
    return F.floor(F.unix_micros(as_col(ts).cast("timestamp")) / 1_000_000).cast("long")
