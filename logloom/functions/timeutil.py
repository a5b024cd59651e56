"""RFC 3339 times: strict parsing of request bounds, and columns for stored texts."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.schema import InvalidInput

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: str, field: str) -> datetime:
    """The instant of text in UTC; an offset is required."""
    try:
        if not re.match(RFC3339, text or ""):
            raise ValueError
        whole = re.sub(r"(\.\d{6})\d+", r"\1", text.upper().replace(" ", "T"))
        return datetime.fromisoformat(whole).astimezone(UTC)
    except (ValueError, OverflowError):
        raise InvalidInput(f"{field} must be an RFC 3339 time such as 2026-01-01T00:00:00Z") from None


def render_utc(at: datetime) -> str:
    """The instant with the suffix +00:00, with as many fractional digits as it needs of 3 or 6."""
    at = at.astimezone(UTC)
    return at.isoformat(timespec="seconds" if not at.microsecond else "milliseconds" if at.microsecond % 1000 == 0 else "microseconds")


def instant(text: Column) -> Column:
    """The microsecond timestamp of an RFC 3339 text; null for any other text."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(text), " ", "T"), r"(\.\d{6})\d+", "$1")))


def nanos(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text; null for any other text."""
    digits = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0")
    seconds = F.unix_timestamp(F.date_trunc("second", instant(text)))
    return seconds * 1_000_000_000 + F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0))


def utc_text(ts: Column) -> Column:
    """A timestamp as RFC 3339 text with microseconds, in a session whose time zone is UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
