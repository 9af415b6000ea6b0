"""Arithmetic on time intervals, in seconds from the start of a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length over the joint extent; 0 when disjoint."""
    shared = overlap(start_a, end_a, start_b, end_b)
    extent = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when((shared > 0.0) & (extent > 0.0), shared / extent).otherwise(F.lit(0.0))


def centre(start: Column, end: Column) -> Column:
    return (start + end) / F.lit(2.0)
