"""Expressions over timestamps; thresholds are plain literals so that they reach the scan."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F


def utc(moment: datetime | str) -> datetime:
    """Naive UTC datetime."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def literal(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f") + "Z").cast("timestamp")


def parse(text: Column) -> Column:
    """Wire text to whole seconds; null when it is not a time."""
    return F.date_trunc("second", text.try_cast("timestamp"))


def epoch(moment: Column) -> Column:
    return F.unix_seconds(F.date_trunc("second", moment.cast("timestamp")))


def _whole(moment: datetime) -> datetime:
    return moment.replace(microsecond=0)


def before(moment: Column, limit: datetime) -> Column:
    """Whole seconds of the value are before the limit (equality fails).

    Truncating a column would hide it from the scan, so the limit is rounded
    up instead: floor(t) < T is the same as t < ceil(T).
    """
    up = limit if limit.microsecond == 0 else _whole(limit) + timedelta(seconds=1)
    return moment < literal(up)


def after(moment: Column, limit: datetime) -> Column:
    """Whole seconds of the value are after the limit: t >= floor(T) + 1."""
    return moment >= literal(_whole(limit) + timedelta(seconds=1))
