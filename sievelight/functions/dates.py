"""Dates at a resolution, as sortable strings, numbers and ISO text; UTC throughout."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Resolution(Enum):
    """(digits of the string form, microseconds of a step or 0)."""

    YEAR = (4, 0)
    MONTH = (6, 0)
    DAY = (8, 86_400_000_000)
    HOUR = (10, 3_600_000_000)
    MINUTE = (12, 60_000_000)
    SECOND = (14, 1_000_000)
    MILLISECOND = (17, 1_000)

    @classmethod
    def of(cls, name: str | None) -> Resolution | None:
        """The one of that name; an unknown name means DAY, none means none."""
        if name is None:
            return None
        return cls.__members__.get(name.upper(), cls.DAY)

    @property
    def digits(self) -> int:
        return self.value[0]


_FULL = "yyyyMMddHHmmssSSS"
_ISO = {4: "yyyy", 6: "yyyy-MM", 8: "yyyy-MM-dd", 10: "yyyy-MM-dd'T'HH", 12: "yyyy-MM-dd'T'HH:mm", 14: "yyyy-MM-dd'T'HH:mm:ss", 17: "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def to_string(ts: Column, resolution: Resolution) -> Column:
    return F.date_format(ts, _FULL[: resolution.digits])


def to_number(ts: Column, resolution: Resolution) -> Column:
    """yyyy, yyyyMM or yyyyMMdd as int from days up, else whole units since 1970 as bigint."""
    if resolution.digits <= 8:
        return F.date_format(ts, _FULL[: resolution.digits]).cast("int")
    return F.floor(F.unix_micros(ts.cast("timestamp")) / resolution.value[1]).cast("bigint")


def to_iso(ts: Column, resolution: Resolution) -> Column:
    return F.date_format(ts, _ISO[resolution.digits])


def is_date_string(value: Column) -> Column:
    """Whether a string is a date at some resolution, by its length."""
    return value.rlike(r"^(\d{4}|\d{6}|\d{8}|\d{10}|\d{12}|\d{14}|\d{17})$")


def string_to_iso_date(value: Column) -> Column:
    """yyyy-MM-dd or a shorter part of it of a sortable date string; null for anything else."""
    cut = [F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)]
    n = F.length(value)
    return F.when(is_date_string(value), F.when(n >= 8, F.concat_ws("-", *cut)).when(n == 6, F.concat_ws("-", *cut[:2])).otherwise(cut[0]))


def string_to_iso(value: Column, offset: str = "Z") -> Column:
    """ISO date, with time and offset where the string has a time."""
    time = F.concat_ws(":", F.substring(value, 9, 2), F.when(F.length(value) >= 12, F.substring(value, 11, 2)).otherwise("00"), F.when(F.length(value) >= 14, F.substring(value, 13, 2)).otherwise("00"))
    return F.when(is_date_string(value) & (F.length(value) >= 10), F.concat(string_to_iso_date(value), F.lit("T"), time, F.lit(offset))).otherwise(string_to_iso_date(value))


def truncate(at: datetime, resolution: Resolution) -> datetime:
    at = at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)
    zero = {"YEAR": dict(month=1, day=1, hour=0), "MONTH": dict(day=1, hour=0), "DAY": dict(hour=0), "HOUR": {}}
    if resolution.name in zero:
        return at.replace(minute=0, second=0, microsecond=0, **zero[resolution.name])
    micros = at.microsecond // 1000 * 1000 if resolution is Resolution.MILLISECOND else 0
    return at.replace(second=0 if resolution is Resolution.MINUTE else at.second, microsecond=micros)


def step_after(at: datetime, resolution: Resolution) -> datetime:
    """The first moment after the unit that holds `at`."""
    low = truncate(at, resolution)
    if resolution is Resolution.YEAR:
        return low.replace(year=low.year + 1)
    if resolution is Resolution.MONTH:
        return low.replace(year=low.year + low.month // 12, month=low.month % 12 + 1)
    return low + timedelta(microseconds=resolution.value[1])


def format_string(at: datetime, resolution: Resolution) -> str:
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y%m%d%H%M%S%f")[: resolution.digits]


def range_struct(low: Column, high: Column, with_min: bool, with_max: bool) -> Column:
    return F.struct(low.alias("from"), high.alias("to"), F.lit(with_min).alias("include_from"), F.lit(with_max).alias("include_to"))
