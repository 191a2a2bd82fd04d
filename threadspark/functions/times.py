"""Clock helpers. Batch columns hold UTC wall time as ``timestamp_ntz``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

# The named windows of the `timeframe` rule.
TIMEFRAMES = {
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "year": "INTERVAL 1 YEAR",
}

# Fixed value: the end of an ISO text with a zone.
ISO_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def ntz(moment: datetime) -> Column:
    """A zone-free literal, so that it means the same in every session zone."""
    return F.expr(f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'")


def hours_before(moment: datetime, hours: float) -> Column:
    """``moment - hours`` folded on the driver, so a comparison with it reaches the scan."""
    return ntz(moment - timedelta(hours=hours))


def from_epoch(seconds: Column) -> Column:
    """UTC wall time of an epoch in seconds."""
    micros = F.round(seconds * 1_000_000).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def epoch_micros(column: Column) -> Column:
    """Microseconds since the epoch of a UTC wall time, put together without a zone conversion."""
    days = F.unix_date(column.cast("date")).cast("long") * 86_400_000_000
    minutes = (F.hour(column) * 60 + F.minute(column)).cast("long") * 60_000_000
    return days + minutes + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")


def parse_iso(text: Column) -> Column:
    """UTC wall time of an ISO text; ``Z`` and offsets are understood, bad text gives null."""
    zoned = F.when(text.rlike(ISO_ZONED), text).otherwise(F.concat(text, F.lit("Z")))
    instant = zoned.try_cast("timestamp")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH))


def parse_plain(text: Column, pattern: str) -> Column:
    """Zone-free time of a text of one fixed shape (given as a regex); other text gives null."""
    return F.when(text.rlike(pattern), text.try_cast("timestamp_ntz"))


def day_text(column: Column) -> Column:
    """``yyyy-MM-dd``; like its siblings cut from the plain text, so no zone is involved."""
    return F.substring(column.cast("string"), 1, 10)


def minute_text(column: Column) -> Column:
    """``yyyy-MM-dd HH:mm``"""
    return F.substring(column.cast("string"), 1, 16)


def iso_text(column: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``"""
    return F.replace(F.substring(column.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def to_instant(column: Column) -> Column:
    """UTC wall time as an instant, the type a watermark needs; independent of the session zone."""
    return F.timestamp_micros(epoch_micros(column))


def to_wall(column: Column) -> Column:
    """The inverse of ``to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(column), F.expr(EPOCH))
