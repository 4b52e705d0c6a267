"""Time texts. Sessions run in UTC; the text 'YYYY-MM-DD HH:MM:SS' is what events hold and compare."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TIME = "Not a time"
FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Microseconds from 1601-01-01 and from 2001-01-01 to 1970-01-01.
FILETIME_EPOCH, COCOA_EPOCH = 11_644_473_600_000_000, 978_307_200


#: First and last microsecond of the years 1 to 9999: the text holds no others.
FIRST_MICRO, LAST_MICRO = -62_135_596_800_000_000, 253_402_300_799_999_999


def micros_text(us: Column) -> Column:
    """Null for times that the text form can't hold."""
    return F.when(us.between(FIRST_MICRO, LAST_MICRO), F.date_format(F.timestamp_micros(us), FORMAT))


def seconds_text(s: Column) -> Column:
    return micros_text(F.try_multiply(s, F.lit(1_000_000)))


def l2t_date(c: Column) -> Column:
    """MM/DD/YYYY or YYYY-MM-DD as the latter, else 0000-00-00."""
    american = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.date_format(F.try_to_timestamp(c, F.lit("MM/dd/yyyy")), "yyyy-MM-dd"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), c)
    return F.coalesce(american, iso, F.lit("0000-00-00"))


def l2t_time(c: Column) -> Column:
    """A valid HH:MM:SS as it stands, else 00:00:00."""
    return F.when(c.rlike(r"^([01]?\d|2[0-3]):[0-5]\d:[0-5]\d([.,]\d+)?$"), c).otherwise("00:00:00")


def filetime_text(ticks: Column) -> Column:
    """100 ns ticks since 1601; none before the first."""
    return F.when(ticks <= 0, NO_TIME).otherwise(micros_text(F.floor(ticks / F.lit(10).cast("decimal(20,0)")).cast("long") - FILETIME_EPOCH))


def tln_time(epoch: Column) -> Column:
    return F.when(epoch > 0, seconds_text(epoch)).otherwise(NO_TIME)


def date_time_object(class_name: Column, is_number: Column, n: Column, fraction: Column) -> Column:
    """Text of a nested time value: n its number cut to a whole one, fraction the same as double."""
    unset = F.lower(class_name).isin("notset", "not set")
    kind = F.coalesce(class_name, F.lit(""))
    text = (
        F.when(kind == "Filetime", filetime_text(n))
        .when(kind == "PosixTimeInMicroseconds", micros_text(n))
        .when(kind.isin("PosixTime", "FATDateTime"), seconds_text(n))
        .when(kind == "WebKitTime", filetime_text(F.try_multiply(n, F.lit(10))))
        .when(kind == "CocoaTime", seconds_text(F.try_add(n, F.lit(COCOA_EPOCH))))
        .when(kind == "JavaTime", micros_text(F.try_multiply(n, F.lit(1000))))
        .when(fraction > 1e11, filetime_text(n))
        .when(fraction > 0, seconds_text(n))
    )
    return F.when(unset, NO_TIME).when(is_number, F.coalesce(text, F.lit(""))).otherwise("")


def iso_to_utc(c: Column) -> Column:
    """ISO date-times with T converted to UTC, fractions dropped; all else as it stands."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?$")
    return F.coalesce(F.when(iso, F.date_format(F.translate(c, ",", ".").try_cast("timestamp"), FORMAT)), c)


def drop_offset(c: Column) -> Column:
    """ISO date-times with the T replaced and offset and fraction cut off, not converted."""
    spaced = F.regexp_replace(c, "^([^T]*)T", "$1 ")
    late_plus = F.locate("+", spaced) > 11
    cut = F.when(late_plus, F.substring_index(spaced, "+", 1)).when(F.locate("Z", spaced) > 11, F.substring_index(spaced, "Z", 1)).otherwise(spaced)
    cut = F.when(F.locate(".", cut) > 11, F.substring_index(cut, ".", 1)).otherwise(cut)
    whole = F.when(c.contains("T"), cut).otherwise(c)
    return F.when(c.isin("", "-", "0000-00-00T00:00:00+00:00"), "").otherwise(F.substring(whole, 1, 19))


def store_time(c: Column) -> Column:
    """A timestamp for what looks like a date-time, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}") & ~c.startswith("0000"), F.substring(c, 1, 19).try_cast("timestamp_ntz"))


def expand_date(value: str, end: bool = False) -> str:
    """A year, month or day as the start, or the end, of that period; all else as it stands."""
    value = value.strip()
    if " " in value or not (m := re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", value)):
        return value
    year, month, day = m.groups()
    if not end:
        return f"{year}-{month or '01'}-{day or '01'} 00:00:00"
    if not day:
        month = month or "12"
        if not 1 <= int(month) <= 12:
            return value
        day = f"{calendar.monthrange(int(year) or 4, int(month))[1]:02d}"
    return f"{year}-{month}-{day} 23:59:59"


def bucket_bounds(bucket: Column) -> tuple[Column, Column]:
    """bucket_range of a column of buckets."""
    last_day = F.date_format(F.last_day(F.concat(F.substring(bucket, 1, 7), F.lit("-01"))), "yyyy-MM-dd")
    hour, day = F.length(bucket) > 10, F.length(bucket) == 10
    first = F.when(hour, F.concat(F.substring(bucket, 1, 13), F.lit(":00:00"))).when(day, F.concat(bucket, F.lit(" 00:00:00"))).otherwise(F.concat(F.substring(bucket, 1, 7), F.lit("-01 00:00:00")))
    last = F.when(hour, F.concat(F.substring(bucket, 1, 13), F.lit(":59:59"))).when(day, F.concat(bucket, F.lit(" 23:59:59"))).otherwise(F.concat(last_day, F.lit(" 23:59:59")))
    return first, last


def bucket_range(bucket: str) -> tuple[str, str]:
    """First and last second of a histogram bucket: a month, a day or an hour."""
    if len(bucket) > 10:
        return f"{bucket[:13]}:00:00", f"{bucket[:13]}:59:59"
    return expand_date(bucket), expand_date(bucket, end=True)
