"""Time expressions. The session time zone is UTC (see ``session.use_utc``)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def parse_ts(c: Column, formats: Sequence[str] = ()) -> Column:
    """String to timestamp; what cannot be read is null.

    ISO text with ``Z`` or an offset needs no format. Free-form dates are read
    by the given formats, tried in order after ISO. Timestamps pass through.
    """
    attempts = [F.try_to_timestamp(c.cast("string"))]
    attempts += [F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats]
    return F.coalesce(*attempts)


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_start(month: str) -> Column:
    """First instant of a ``yyyy-MM`` month, as a literal."""
    if not _MONTH.fullmatch(month):
        raise ValueError(f"month must look like 2024-05, got {month!r}")
    return F.expr(f"timestamp'{month}-01T00:00:00Z'")


def next_month(month: str) -> str:
    month_start(month)
    year, number = int(month[:4]), int(month[5:])
    return f"{year + number // 12:04d}-{number % 12 + 1:02d}"


def in_month_range(ts: Column, since: str, until: str) -> Column:
    """``since`` inclusive, ``until`` exclusive, both ``yyyy-MM``."""
    return (ts >= month_start(since)) & (ts < month_start(until))
