"""Elapsed time between an impression and a conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_crossed(later: Column, earlier: Column) -> Column:
    """Hour boundaries between two instants: 00:59 to 01:01 counts 1."""
    floor_later = F.unix_seconds(F.date_trunc("HOUR", later))
    floor_earlier = F.unix_seconds(F.date_trunc("HOUR", earlier))
    return ((floor_later - floor_earlier) / F.lit(3600)).cast("bigint")


def hours_at_least_one(later: Column, earlier: Column) -> Column:
    hours = hours_crossed(later, earlier)
    return F.when(hours == 0, F.lit(1).cast("bigint")).otherwise(hours)


def days_rounded_up(hours: Column) -> Column:
    """Whole days, a started day counting in full: 26 hours make 2 days."""
    return F.ceil(hours / F.lit(24)).cast("int")


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))
