"""Buckets, civil dates and their bounds. Nothing here depends on the session's time zone."""

from __future__ import annotations

import datetime
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_SECONDS = 900
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
EPOCH = "TIMESTAMP_NTZ'1970-01-01'"


def bucket_of(ts: str) -> str:
    """SQL for the start of the 900-second bucket of an RFC 3339 string; a bare date counts as its noon in UTC, anything else as null."""
    noon = f"concat({ts}, 'T12:00:00Z')"
    parsed = f"unix_seconds(try_cast(case when {ts} rlike '{DATE}' then {noon} when {ts} rlike '{RFC3339}' then upper({ts}) end as timestamp))"
    return f"cast(floor({parsed} / {BUCKET_SECONDS}) * {BUCKET_SECONDS} as bigint)".replace("\\d", "[0-9]").replace("\\.", "[.]")


def to_bucket(ts: str) -> Column:
    return F.expr(bucket_of(ts))


def civil_date(bucket: str, tz: str) -> Column:
    """Local date of an epoch second, as text; null where the year isn't within 1..9999."""
    local = f"convert_timezone('UTC', '{resolve_timezone(tz)}', timestampadd(SECOND, {bucket}, {EPOCH}))"
    return F.expr(f"if(year({local}) between 1 and 9999, date_format({local}, 'yyyy-MM-dd'), null)")


def resolve_timezone(name: str) -> str:
    """The name, if it is an IANA zone; an error else."""
    ZoneInfo(name)
    return name


def validate_range(start: str | None, end: str | None) -> tuple[str, str] | None:
    """Both dates or neither, strictly YYYY-MM-DD, years 1970..9999, in order."""
    if start is None and end is None:
        return None
    if start is None or end is None:
        raise ValueError("a range has a start and an end")
    for x in (start, end):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) or datetime.date.fromisoformat(x).year < 1970:
            raise ValueError(f"not a date from 1970 to 9999: {x!r}")
    if start > end:
        raise ValueError("the range ends before it starts")
    return start, end


def range_problem(start: str, end: str) -> Column:
    """As validate_range() for two text columns: why they are no range; null for a range or none at all."""
    a, b = F.col(start), F.col(end)
    real = lambda c: F.coalesce(F.regexp_like(c, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & c.try_cast("date").isNotNull() & (c >= "1970-01-01"), F.lit(False))
    return F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), "half").when(~real(a) | ~real(b), "no date").when(a > b, "order")


def _local_start(day: datetime.date, zone: ZoneInfo) -> int:
    """First second of a local day; where midnight is skipped, the first that exists."""
    for minutes in range(0, 24 * 60 + 1, 15):
        local = datetime.datetime.combine(day, datetime.time()) + datetime.timedelta(minutes=minutes)
        at = local.replace(tzinfo=zone).timestamp()
        if datetime.datetime.fromtimestamp(at, zone).replace(tzinfo=None) == local:
            return int(at)
    return _local_start(day + datetime.timedelta(days=1), zone)


def day_range_epochs(start: str, end: str, tz: str) -> tuple[int, int]:
    """Half-open UTC seconds of inclusive local dates; a day that the zone skips is empty."""
    zone = ZoneInfo(tz)
    after = datetime.date.fromisoformat(end) + datetime.timedelta(days=1)
    return _local_start(datetime.date.fromisoformat(start), zone), _local_start(after, zone)


def preset_range(days: int | None, today: datetime.date) -> tuple[str, str] | None:
    """The last N days with today, from 1970-01-01 at most; none for 0."""
    if not days:
        return None
    first = max(datetime.date(1970, 1, 1), today - datetime.timedelta(days=days - 1))
    return first.isoformat(), today.isoformat()


def resolve_bounds(tz: str, today: datetime.date, days: int | None = None, start: str | None = None, end: str | None = None) -> tuple[int | None, int | None]:
    """Own dates beat the preset; without either there are no bounds."""
    chosen = validate_range(start, end) or preset_range(days, today)
    return day_range_epochs(*chosen, tz) if chosen else (None, None)


def mixed_ts_ms(text: str) -> Column:
    """Epoch milliseconds of numeric text (seconds under 2e10, else milliseconds) or of an RFC 3339 string."""
    number = f"try_cast({text} as double)"
    iso = f"unix_millis(try_cast(if({text} rlike '{RFC3339}', upper({text}), null) as timestamp))".replace("\\d", "[0-9]").replace("\\.", "[.]")
    return F.expr(f"cast(case when {number} is null then {iso} when {number} < 2e10 then {number} * 1000 else {number} end as bigint)")


def calendar_window(year: int | None, today: datetime.date) -> tuple[str, str]:
    """The trailing 364 days, or a year, the current one up to today."""
    if year is None:
        return (today - datetime.timedelta(days=364)).isoformat(), today.isoformat()
    return f"{year:04d}-01-01", today.isoformat() if year == today.year else f"{year:04d}-12-31"
