"""RFC 3339 instants as epoch milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANT = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(?:[Zz]|([+-])(\d{2}):(\d{2}))?$"
_SHAPE = re.compile(_INSTANT.replace(r"\d", "[0-9]"))


def instant_ms(text: str | None) -> int | None:
    """Milliseconds since the epoch, or None for anything but a valid instant.

    A fraction is cut to milliseconds, second 60 counts as 59, and a missing zone means UTC.
    """
    m = _SHAPE.fullmatch(text) if isinstance(text, str) else None
    if m is None:
        return None
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    if second > 60 or (m[8] and (int(m[9]) > 23 or int(m[10]) > 59)):
        return None
    try:
        at = datetime(max(year, 1), month, day, hour, minute, min(second, 59), tzinfo=timezone.utc)
    except ValueError:
        return None
    if year == 0:  # a leap year before the calendar of datetime
        return None
    shift = timedelta(hours=int(m[9]), minutes=int(m[10])) * (-1 if m[8] == "-" else 1) if m[8] else timedelta()
    whole = (at - shift - datetime(1970, 1, 1, tzinfo=timezone.utc)) if year > 1 else (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) - shift
    return (whole.days * 86_400 + whole.seconds) * 1000 + int((m[7] or "")[:3].ljust(3, "0"))


def instant_ms_column(text: Column) -> Column:
    """`instant_ms` in native functions."""
    part = lambda i: F.regexp_extract(text, _INSTANT, i)
    second = F.when(part(6) == "60", F.lit("59")).otherwise(part(6))
    stamp = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), second)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(stamp, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX")))
    shift = F.when(part(8) == "", F.lit(0)).otherwise(
        (part(9).try_cast("int") * 3600 + part(10).try_cast("int") * 60) * F.when(part(8) == "-", F.lit(-1)).otherwise(F.lit(1))
    )
    valid = text.rlike(_INSTANT) & (part(6).try_cast("int") <= 60) & ((part(8) == "") | ((part(9).try_cast("int") <= 23) & (part(10).try_cast("int") <= 59)))
    millis = F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("int")
    return F.when(valid, (seconds - shift) * 1000 + millis).cast("long")


def epoch_ms(stamp: Column) -> Column:
    """A timestamp without zone, read as UTC, as epoch milliseconds."""
    return F.unix_millis(stamp.cast("timestamp")).cast("long")
