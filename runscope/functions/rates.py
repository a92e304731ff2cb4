"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runscope.formats import CLOCK_HZ


def cycles_to_seconds(cycles: Column, hz: float = CLOCK_HZ) -> Column:
    """Simulated seconds of a cycle count."""
    return cycles / F.lit(float(hz))


def per_kilo(count: Column, instructions: Column) -> Column:
    """Events per thousand instructions; NULL instead of a division by zero."""
    return F.try_divide(count.cast("double"), instructions.cast("double") / F.lit(1000.0))


def host_walltime(started_at: Column, ended_at: Column) -> Column:
    """Elapsed seconds."""
    return F.timestamp_diff("MICROSECOND", started_at, ended_at) / F.lit(1e6)
