"""Three-valued comparison of intervals, whose ends are null where they are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside(lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """Whether a value that is known to be in [lo, hi] is in [low, high]: true if all of the interval is, false if none is, else null.

    A null lo or hi is an open end; with both null nothing is known of the value, and the answer is null.  low and high
    are given.
    """
    none = F.coalesce(hi < low, F.lit(False)) | F.coalesce(lo > high, F.lit(False))
    whole = F.coalesce((lo >= low) & (hi <= high), F.lit(False))
    return F.when(whole, True).when(none, False)


def below(lo: Column, hi: Column, most: Column) -> Column:
    """Whether a value that is known to be in [lo, hi] is less than most: true, false or null, as in inside."""
    return F.when(F.coalesce(hi < most, F.lit(False)), True).when(F.coalesce(lo >= most, F.lit(False)), False)


def any_of(verdict: Column) -> Column:
    """Aggregate of three-valued verdicts: true if one is, else null if one isn't known, else false; null of no rows."""
    return F.when(F.coalesce(F.bool_or(verdict), F.lit(False)), True).when(F.count_if(verdict.isNull()) == 0, F.bool_or(verdict))
