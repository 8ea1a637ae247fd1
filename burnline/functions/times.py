"""Time columns: ISO text, local clocks and reset phrases.

Instants are epoch micros, and a zone's clock is micros too: those that its wall clock would show in UTC. Days, hours
and names are then plain arithmetic, so no result depends on the session's zone."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnline.dims import DAY, HOUR

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "Mon Tue Wed Thu Fri Sat Sun".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clock_us(us: Column, tz: str | Column) -> Column:
    """The zone's clock at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us.cast("bigint")), tz))


def instant_us(clock: Column, tz: str | Column) -> Column:
    """The instant at which the zone's clock shows this."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(clock.cast("bigint")), tz))


def day_of(clock: Column) -> Column:
    """Days since 1970-01-01 on a clock."""
    return F.floor(clock / DAY).cast("int")


def weekday_of(clock: Column) -> Column:
    """0 on Mondays; day 0 was a Thursday."""
    return F.pmod(day_of(clock) + 3, F.lit(7))


def hour_of(clock: Column) -> Column:
    return F.floor(F.pmod(clock, F.lit(DAY)) / HOUR).cast("int")


def naive_us(stamp: Column) -> Column:
    """Micros of a timestamp without a zone, read as UTC."""
    whole = F.unix_date(stamp.cast("date")).cast("bigint") * DAY + F.hour(stamp) * HOUR + F.minute(stamp).cast("bigint") * 60_000_000
    return whole + (F.extract(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")


def utc_text(seconds: Column) -> Column:
    """`2024-01-02T03:04:05Z` of whole epoch seconds."""
    part = lambda n, every: F.lpad(F.pmod(F.floor(seconds / n), F.lit(every)).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def iso_to_us(text: Column) -> Column:
    """Epoch micros of an ISO-8601 time; null for anything else. A time without a zone is in UTC."""
    dated = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|\s*$)")
    t = F.trim(text)
    bare = F.when(t.rlike(r"^\S{10}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"[T ]\d{2}:\d{2}$"), F.concat(t, F.lit(":00Z"))).when(t.rlike(r"[T ]\d{2}:\d{2}:\d{2}(\.\d*)?$"), F.concat(t, F.lit("Z")))
    return F.when(dated, F.unix_micros(F.try_to_timestamp(F.coalesce(bare, t))))


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    return tuple(sorted(available_timezones()))


def reset_phrase_us(phrase: Column, zone: Column, now_us: Column) -> Column:
    """Epoch micros of `Jul 29 at 5:30pm`, `Jul 29, 5pm` or `5pm` in an IANA zone, judged at now; null where unsound.

    Without a date the next such time counts; without a year, the year that does
    not put the date two whole days or more into the past."""
    pattern = r"(?i)^\s*(?:([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(?:at\s+)?)?(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(phrase, pattern, i), F.lit(""))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1))).cast("int")
    day, hour12, minute = part(2).cast("int"), part(3).cast("int"), F.coalesce(part(4).cast("int"), F.lit(0))
    hour = F.when(hour12.between(1, 12), hour12 % 12 + F.when(F.lower(part(5)) == "pm", 12).otherwise(0))
    known = zone.isin(*zone_names())
    safe = F.when(known, zone).otherwise("UTC")
    clock = clock_us(now_us, safe)
    year = F.year(F.date_from_unix_date(day_of(clock)))
    good = known & hour.isNotNull() & minute.between(0, 59)
    of_day = F.when(good, hour * HOUR + minute.cast("bigint") * 60_000_000).cast("bigint")

    def at(y: Column) -> Column:
        date = F.try_make_timestamp_ntz(y, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return instant_us(F.unix_date(date).cast("bigint") * DAY + of_day, safe)

    dated = let(at(year), lambda t: F.when(F.floor((now_us - t) / DAY) >= 2, at(year + 1)).otherwise(t))
    today = instant_us(day_of(clock).cast("bigint") * DAY + of_day, safe)
    undated = let(today, lambda t: F.when(t <= now_us, t + DAY).otherwise(t))
    return F.when(good, F.when(part(1).isNotNull(), dated).otherwise(undated))


def day_and_time(us: Column, tz: str) -> Column:
    """`Mon 17:00` on the zone's clock."""
    clock = clock_us(us, tz)
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday_of(clock) + 1)
    minute = F.floor(F.pmod(clock, F.lit(HOUR)) / 60_000_000)
    return F.concat(name, F.lit(" "), F.lpad(hour_of(clock).cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
