"""Prague calendar days, wall-clock parsing and the date ranges of the feed."""

from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.config import SINGLE_EVENT_HOURS, TIME_ZONE

_END_OF_DAY = "INTERVAL '23:59:59.999' HOUR TO SECOND"


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def to_ms(ts: Column) -> Column:
    """Drop what is finer than the millisecond the tables store."""
    return F.date_trunc("MILLISECOND", ts)


def prague_local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, TIME_ZONE)


def prague_day(ts: Column) -> Column:
    return F.to_date(prague_local(ts))


def is_multi_day(starts: Column, ends: Column) -> Column:
    return ends.isNotNull() & (prague_day(starts) != prague_day(ends))


def date_label_kind(starts: Column, ends: Column) -> Column:
    return F.when(F.coalesce(is_multi_day(starts, ends), F.lit(False)), "range").otherwise("single")


def effective_end(starts: Column, ends: Column) -> Column:
    """A listing without an end counts as two hours long."""
    return F.coalesce(ends, starts + F.expr(f"INTERVAL '{SINGLE_EVENT_HOURS}' HOUR"))


def local_datetime(text: Column) -> Column:
    """``DD.MM.YYYY HH:MM`` or ``YYYY-MM-DD HH:MM`` on a Prague clock, as an instant."""
    day_first = r"^(\d{2})\.(\d{2})\.(\d{4})\s+(\d{2}):(\d{2})$"
    year_first = r"^(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2})$"
    iso = F.regexp_replace(F.regexp_replace(text, day_first, "$3-$2-$1 $4:$5"), year_first, "$1-$2-$3 $4:$5")
    # The pattern itself rejects any other text; a date that does not exist is NULL.
    return F.to_utc_timestamp(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm")), TIME_ZONE)


def resolve_range(when: Column, now: Column) -> Column:
    """``struct<start, end>`` of a date choice; an open end is NULL."""
    local = prague_local(now)
    today = F.to_date(local)
    sunday = F.date_add(today, 6 - F.weekday(today))

    def utc(wall: Column) -> Column:
        return F.to_utc_timestamp(wall, TIME_ZONE)

    friday_evening = utc(F.date_sub(sunday, 2).cast("timestamp") + F.expr("INTERVAL '18' HOUR"))
    start = F.when(when == "weekend", F.greatest(now, friday_evening)).otherwise(now)
    end = (
        F.when(when == "today", utc(today.cast("timestamp") + F.expr(_END_OF_DAY)))
        .when(when == "week", now + F.expr("INTERVAL '168' HOUR"))
        .when(when == "month", now + F.expr("INTERVAL '720' HOUR"))
        .when(when == "weekend", utc(sunday.cast("timestamp") + F.expr(_END_OF_DAY)))
    )
    return F.struct(start.alias("start"), end.alias("end"))


def range_of(when: str | None, now: datetime) -> tuple[datetime, datetime | None]:
    """Driver-side form for one request, so the bounds are literals a scan can use."""
    zone, utc = ZoneInfo(TIME_ZONE), timezone.utc
    now = now if now.tzinfo else now.replace(tzinfo=utc)
    today = now.astimezone(zone).date()

    def wall(day, clock):
        return datetime.combine(day, clock, zone).astimezone(utc)

    last = time(23, 59, 59, 999000)
    if when == "today":
        return now, wall(today, last)
    if when == "week":
        return now, now + timedelta(days=7)
    if when == "month":
        return now, now + timedelta(days=30)
    if when == "weekend":
        sunday = today + timedelta(days=6 - today.weekday())
        return max(now, wall(sunday - timedelta(days=2), time(18))), wall(sunday, last)
    return now, None
