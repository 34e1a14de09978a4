"""Shares and verdicts: numbers that travel with what they were measured over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Observations below which nothing is said, and the shares that make a convention or a leaning.
FLOOR, CONVENTION, WEAK = 5, 0.85, 0.6


def share(part: Column | str, whole: Column | str, digits: int = 3) -> Column:
    """part / whole to three places; null where there was nothing to measure over."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.round(part.cast("double") / F.when(whole != 0, whole).cast("double"), digits)


def floor_percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down, so that only all is 100; 100 where there was nothing to pass."""
    return F.when(whole == 0, F.lit(100)).otherwise(F.floor(100 * part / whole)).cast("long")


def verdict(share_: Column, total: Column) -> Column:
    return F.when(total < FLOOR, "too few to say").when(share_ >= CONVENTION, "convention").when(share_ >= WEAK, "weak").otherwise("split")


def guarded(count: Column, considered: Column) -> tuple[Column, Column]:
    """(value, why): the count, or null and a reason where the pass did not run. 0 stays 0 only if something was looked at."""
    ran = count.isNotNull() & (F.coalesce(considered, F.lit(0)) > 0)
    why = F.when(count.isNull(), "not run").when(~ran, "nothing to look at")
    return F.when(ran, count), why
