"""Time arithmetic on zone-free timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_moment(moment: Column) -> Column:
    """The moment itself; fails where there is none."""
    missing = F.raise_error(F.lit("the snapshot clock is missing or no time")).cast("timestamp_ntz")
    return F.when(moment.isNotNull(), moment).otherwise(missing)


def snapshot_column(snapshot: str | datetime | Column | DataFrame) -> Column:
    """The clock all ages are measured against: a literal, a column, or a one-row frame.

    A frame without a moment fails instead of making all ages null.
    """
    if isinstance(snapshot, DataFrame):
        return known_moment(snapshot.select(F.col(snapshot.columns[0]).cast("timestamp_ntz")).scalar())
    if isinstance(snapshot, Column):
        return snapshot
    return F.lit(str(snapshot)).cast("timestamp_ntz")


def minutes_between(start: Column, end: Column) -> Column:
    """Signed minutes from start to end; null when either is null.

    The difference is taken as an interval, so the session time zone plays no part.
    """
    seconds = (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(60.0)


def rounded_minutes_between(start: Column, end: Column) -> Column:
    return F.round(minutes_between(start, end), 1)


def iso_text(moment: Column) -> Column:
    """ISO-8601 text, with six fractional digits only where there is a fraction."""
    plain = moment.cast("string")
    fraction = F.when(
        F.length(plain) > 19, F.concat(F.lit("."), F.rpad(F.substring(plain, 21, 6), 6, "0"))
    ).otherwise(F.lit(""))
    return F.concat(F.translate(F.substring(plain, 1, 19), " ", "T"), fraction)
