"""Date expressions: F13-F17, F26, P8-P10.

Nothing here reads the clock.  Every "now" is an ``as_of`` argument.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from newsmill import fixed
from newsmill.functions.arrays import col


def parse_date(text: Column | str, formats: Iterable[str], zones: bool = True) -> Column:
    """first of the formats that fits, else null.

    With ``zones`` a trailing offset is honoured by the formats that name one.
    """
    t = F.trim(col(text))
    # The formatter refuses to parse weekday names, so they are removed first.
    t = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def parse_item_date(text: Column | str) -> Column:
    """F13 as the item filter uses it: ISO with the offset dropped, else four formats."""
    t = col(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)", 1)
    return F.when(
        F.contains(t, F.lit("T")), F.try_to_timestamp(F.nullif(iso, F.lit("")))
    ).otherwise(parse_date(t, fixed.DATE_FORMATS_FILTER))


def parse_archive_date(text: Column | str) -> Column:
    return F.to_date(parse_date(F.left(col(text), F.lit(26)), fixed.DATE_FORMATS_ARCHIVE))


def parse_feed_date(text: Column | str, as_of: Column | None = None) -> Column:
    parsed = parse_date(text, fixed.DATE_FORMATS_FEED)
    return parsed if as_of is None else F.coalesce(parsed, relative_date(text, as_of))


def parse_newsletter_date(text: Column | str) -> Column:
    bare = F.trim(F.substring_index(F.substring_index(col(text), "+", 1), "Z", 1))
    return parse_date(bare, fixed.DATE_FORMATS_NEWSLETTER)


def relative_date(text: Column | str, as_of: Column | str) -> Column:
    """``3 days ago`` against ``as_of``; a month counts 30 days."""
    t = F.lower(F.trim(col(text)))
    for prefix in fixed.VIDEO_DATE_PREFIXES:
        t = F.regexp_replace(t, f"^{prefix.lower()}", "")
    n = F.regexp_extract(t, r"^(\d+)\s+\w+", 1).try_cast("bigint")
    unit = F.regexp_extract(t, r"^\d+\s+(\w+)", 1)
    hours = (
        F.when(F.contains(unit, F.lit("hour")), F.lit(1))
        .when(F.contains(unit, F.lit("day")), F.lit(24))
        .when(F.contains(unit, F.lit("week")), F.lit(24 * 7))
        .when(F.contains(unit, F.lit("month")), F.lit(24 * 30))
    )
    # An age before all timestamps gives none.
    micros = F.try_multiply(n, hours.cast("bigint") * 3_600_000_000)
    moved = F.timestamp_micros(F.try_subtract(F.unix_micros(col(as_of)), micros))
    return F.when(F.contains(t, F.lit("ago")), moved)


def age_text(ts: Column | str, as_of: Column | str) -> Column:
    """``just now``, minutes, hours or days before ``as_of``."""
    seconds = F.unix_seconds(col(as_of)) - F.unix_seconds(col(ts))

    def spoken(n: Column, unit: str) -> Column:
        return F.concat(
            n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""), F.lit(" ago")
        )

    whole = lambda size: F.floor(seconds / size)
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, spoken(whole(60), "minute"))
        .when(seconds < 86400, spoken(whole(3600), "hour"))
        .otherwise(spoken(whole(86400), "day"))
    )


def week_label(ts: Column | str, calendar_year: bool = False) -> Column:
    """``Week_<iso week>_<year>``; the ISO year unless ``calendar_year``."""
    t = col(ts)
    year = F.year(t) if calendar_year else F.extract(F.lit("YEAROFWEEK"), t)
    return F.concat_ws("_", F.lit("Week"), F.weekofyear(t).cast("string"), year.cast("string"))


def in_date_range(
    ts: Column | str,
    start: str | None = None,
    end: str | None = None,
    keep_undated: bool = True,
) -> Column:
    """Inside ``[start 00:00:00, end 23:59:59]``."""
    t = col(ts)
    test = F.lit(True)
    if start:
        test = test & (t >= F.to_timestamp(F.lit(f"{start} 00:00:00")))
    if end:
        test = test & (t <= F.to_timestamp(F.lit(f"{end} 23:59:59")))
    return F.when(t.isNull(), F.lit(keep_undated)).otherwise(test)


def in_day_range(
    ts: Column | str,
    start: str | None = None,
    end: str | None = None,
    keep_undated: bool = True,
) -> Column:
    """P10: the same on days only."""
    d = F.to_date(col(ts))
    test = F.lit(True)
    if start:
        test = test & (d >= F.to_date(F.lit(start)))
    if end:
        test = test & (d <= F.to_date(F.lit(end)))
    return F.when(d.isNull(), F.lit(keep_undated)).otherwise(test)


def on_day(ts: Column | str, day: str) -> Column:
    """Dated, and on this day."""
    t = col(ts)
    return t.isNotNull() & (F.to_date(t) == F.to_date(F.lit(day)))


def since(ts: Column | str, cutoff: str) -> Column:
    """Dated, and not before the cutoff."""
    t = col(ts)
    return t.isNotNull() & (t >= F.to_timestamp(F.lit(cutoff)))


def next_run(
    interval: Column | str,
    run_at_time: Column | str,
    run_on_day: Column | str,
    custom_hours: Column | str,
    as_of: Column | str,
) -> Column:
    """when a task runs next."""
    kind, at, now = col(interval), col(run_at_time), col(as_of)
    midnight = F.date_trunc("day", now)
    valid = at.rlike(r"^\s*([01]?\d|2[0-3])\s*:\s*[0-5]?\d\s*$")
    hour = F.when(valid, F.trim(F.substring_index(at, ":", 1)).try_cast("int")).otherwise(9)
    minute = F.when(valid, F.trim(F.substring_index(at, ":", -1)).try_cast("int")).otherwise(0)

    def after(days: Column, hours: Column, minutes: Column) -> Column:
        return midnight + F.make_interval(days=days, hours=hours, mins=minutes)

    zero = F.lit(0)
    step = lambda n: (F.floor(F.hour(now) / n) + 1).cast("int") * n
    today = after(zero, hour, minute)
    ahead = (col(run_on_day) - F.weekday(now)).cast("int")
    passed = F.hour(now) * 60 + F.minute(now) >= hour * 60 + minute
    ahead = ahead + F.when((ahead < 0) | ((ahead == 0) & passed), 7).otherwise(0)
    return (
        F.when(kind == "hourly", F.date_trunc("hour", now) + F.make_interval(hours=F.lit(1)))
        .when(kind == "every_6_hours", after(zero, step(6), zero))
        .when(kind == "every_12_hours", after(zero, step(12), zero))
        .when(kind == "daily", after(F.when(today <= now, 1).otherwise(0), hour, minute))
        .when(kind == "weekly", after(ahead, hour, minute))
        .when(kind == "custom_hours", now + F.make_interval(hours=col(custom_hours).cast("int")))
        .otherwise(now + F.make_interval(days=F.lit(1)))
    )
