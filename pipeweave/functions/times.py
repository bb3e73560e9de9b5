"""Dates, wall clocks (no zone), instants (UTC) and durations. Wall clocks are ``timestamp_ntz``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime letters and the pattern letters that Spark reads.
PATTERN = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "z": "xx", "f": "SSSSSS"}
ISO_DATE, CLOCK = r"\d{4}-\d{2}-\d{2}", r"[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
DURATION = r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def pattern(strftime: str) -> str:
    """A strftime pattern as a Spark one."""
    out, i = [], 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            out.append("%" if strftime[i] == "%" else PATTERN[strftime[i]])
        else:
            out.append(f"'{c}'" if c.isalpha() else c)
        i += 1
    return "".join(out)


def date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def to_date(s: Column) -> Column:
    return F.when(s.rlike(f"^{ISO_DATE}$"), s.try_cast("date"))


def to_datetime(s: Column) -> Column:
    return F.when(s.rlike(f"^{ISO_DATE}({CLOCK})?$"), s.try_cast("timestamp_ntz"))


def to_instant(s: Column) -> Column:
    return F.when(s.rlike(f"^{ISO_DATE}{CLOCK}(Z|[+-]\\d{{2}}:?\\d{{2}})$"), s.try_cast("timestamp"))


def to_duration(s: Column) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, DURATION, i), F.lit("")), F.lit("0"))
    whole = F.make_dt_interval(part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("decimal(18,6)"))
    return F.when(s.rlike(DURATION) & ~s.rlike("^-?PT?$"), F.when(s.startswith("-"), -whole).otherwise(whole))


def parse_date(s: Column, strftime: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern(strftime))).cast("date")


def parse_datetime(s: Column, strftime: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern(strftime))).cast("timestamp_ntz")


def parse_instant(s: Column, strftime: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern(strftime)))


def duration(days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


def at(instant: Column, zone: str) -> Column:
    """The wall clock of an instant in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))


def in_zone(clock: Column, zone: str) -> Column:
    """The instant of a wall clock in a zone: gaps move on, of two the earlier."""
    return F.to_utc_timestamp(clock.cast("timestamp"), zone)


def offset(instant: Column, zone: str) -> Column:
    return at(instant, zone) - instant.cast("timestamp_ntz")


def year(d: Column) -> Column:
    return F.year(d).cast("bigint")


def month(d: Column) -> Column:
    return F.month(d).cast("bigint")


def day(d: Column) -> Column:
    return F.dayofmonth(d).cast("bigint")


def weekday(d: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(d) + 1).cast("bigint")


def day_of_year(d: Column) -> Column:
    return F.dayofyear(d).cast("bigint")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d).cast("bigint")


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("bigint")


def date_of(clock: Column) -> Column:
    return clock.cast("date")


def hour(t: Column) -> Column:
    return F.hour(t).cast("bigint")


def minute(t: Column) -> Column:
    return F.minute(t).cast("bigint")


def second(t: Column) -> Column:
    return F.second(t).cast("bigint")


def nanosecond(t: Column) -> Column:
    return (F.extract(F.lit("SECOND"), t) * 1000000000 % 1000000000).cast("bigint")


def unix_seconds(t: Column) -> Column:
    return F.unix_seconds(t)


def unix_millis(t: Column) -> Column:
    return F.unix_millis(t)


def total_seconds(d: Column) -> Column:
    part = lambda unit: F.extract(F.lit(unit), d)
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def total_millis(d: Column) -> Column:
    return (total_seconds(d) * 1000).cast("bigint")


def plus(t: Column, d: Column) -> Column:
    return t + d


def minus(t: Column, d: Column) -> Column:
    return t - d


def since(t: Column, earlier: Column) -> Column:
    return t - earlier


def negate(d: Column) -> Column:
    return -d


def times(d: Column, n: int) -> Column:
    return d * F.lit(n)


def add_days(d: Column, n: int, clock: bool = False) -> Column:
    return d + duration(days=n) if clock else F.date_add(d, n)


def add_months(d: Column, n: int, clock: bool = False) -> Column:
    """Clamped to the month's end; a wall clock keeps its time."""
    return d + F.make_ym_interval(F.lit(0), F.lit(n)) if clock else F.add_months(d, n)


def add_years(d: Column, n: int, clock: bool = False) -> Column:
    return add_months(d, 12 * n, clock)


def days_since(d: Column, earlier: Column) -> Column:
    return F.datediff(d, earlier).cast("bigint")


def truncate(t: Column, unit: str, zone: str | None = None) -> Column:
    if zone:
        return in_zone(F.date_trunc(unit, at(t, zone)).cast("timestamp_ntz"), zone)
    return F.date_trunc(unit, t)


def truncate_date(d: Column, unit: str) -> Column:
    return F.trunc(d, unit)


def dates(d: Column, end: Column) -> Column:
    """The days from d to the day before end."""
    return F.when(end > d, F.sequence(d, F.date_sub(end, 1))).otherwise(F.array().cast("array<date>"))


def fmt(t: Column, strftime: str, zone: str | None = None) -> Column:
    return F.date_format(at(t, zone) if zone else t, pattern(strftime))


def now() -> Column:
    return F.current_timestamp()


def today(zone: str | None = None) -> Column:
    return at(F.current_timestamp(), zone).cast("date") if zone else F.current_date()


def zone(name: str) -> str:
    """A time zone's name, checked."""
    import zoneinfo

    if name not in zoneinfo.available_timezones():
        raise ValueError(f"no time zone {name}")
    return name


def local_zone() -> Column:
    """The session's time zone."""
    return F.current_timezone()
