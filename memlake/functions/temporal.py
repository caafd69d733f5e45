"""Time functions: exact RFC 3339 sort keys and valid-time membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$"
)


def parse_timestamp(text: Column) -> Column:
    """Struct (original, epoch_s, leap, frac, offset_s) of an RFC 3339 text, or null.

    The fraction keeps any number of digits. A leap second keeps the epoch of the second
    before it and ``leap = 1``, so it sorts after :59 and before the next :00.
    """
    def part(i: int) -> Column:
        return F.regexp_extract(text, _RFC3339, i)

    day = F.try_to_date(part(1), "yyyy-MM-dd")
    hour, minute, second = (part(i).try_cast("int") for i in (2, 3, 4))
    zone = part(6)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    zh, zm = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    offset = F.when(F.upper(zone) == "Z", 0).otherwise(sign * (zh * 3600 + zm * 60))
    leap = (second == 60).cast("int")
    epoch = (
        F.unix_date(day).cast("long") * 86400
        + hour * 3600 + minute * 60 + F.least(second, F.lit(59))
        - offset
    )
    leap_ok = (leap == 0) | (F.pmod(epoch, F.lit(86400)) == 86399)
    zone_ok = (F.upper(zone) == "Z") | ((zh < 24) & (zm < 60))
    valid = (
        text.rlike(_RFC3339) & day.isNotNull() & (hour < 24) & (minute < 60)
        & (second <= 60) & leap_ok & zone_ok
    )
    return F.when(
        F.coalesce(valid, F.lit(False)),
        F.struct(
            text.alias("original"),
            epoch.alias("epoch_s"),
            leap.alias("leap"),
            F.rtrim(part(5), F.lit("0")).alias("frac"),
            offset.cast("int").alias("offset_s"),
        ),
    )


def sort_key(ts: Column) -> Column:
    """Exact order of parsed timestamps: trailing zeros and the offset do not matter."""
    return F.struct(ts["epoch_s"], ts["leap"], ts["frac"])


def valid_at(mode: Column, start: Column, end: Column, t: Column) -> Column:
    """Whether instant ``t`` lies in the valid time (unknown never, intervals half open)."""
    inside = (
        F.when(mode == "instant", t == start)
        .when(mode == "interval", (t >= start) & (t < end))
        .when(mode == "open_ended", t >= start)
        .otherwise(F.lit(False))
    )
    return F.coalesce(inside, F.lit(False))


def valid_time_problem(mode: Column, start: Column, end: Column) -> Column:
    """Reason code of a badly formed valid time, null when it is well formed."""
    shape = (
        F.when(mode == "unknown", start.isNull() & end.isNull())
        .when(mode.isin("instant", "open_ended"), start.isNotNull() & end.isNull())
        .when(mode == "interval", start.isNotNull() & end.isNotNull())
        .otherwise(F.lit(False))
    )
    return F.when(~F.coalesce(shape, F.lit(False)), F.lit("BoundaryCombination")).when(
        (mode == "interval") & ~(start < end), F.lit("IntervalOrder")
    )
