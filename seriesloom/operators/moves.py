"""Fills, changes and rolling statistics over one series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import ratio


def last_seen(c: str, w, at: str) -> Column:
    """Last known value up to the row, with its ``at``. The frame only grows, so a row costs one step however far it looks back."""
    return F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("v"))),
                  ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def within(seen: Column, limit: int, at: str | Column = "day") -> Column:
    """Value of ``last_seen`` if it lies not more than ``limit`` steps back."""
    here = F.col(at) if isinstance(at, str) else at
    return F.when(here - seen["at"] <= limit, seen["v"])


def filled(c: str, w, limit: int | None, at: str = "pos") -> Column:
    """Last known value not more than ``limit`` steps of ``at`` back (any distance for None).

    ``at`` is the row number for a limit in rows and the day number for one in days.
    """
    if limit is None:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return within(last_seen(c, w, at), limit, at)


def filled_days(c: str, w, limit: int) -> Column:
    """Last known value of the last ``limit`` calendar days; needs no dense calendar."""
    return filled(c, w, limit, "day")


def blocks(c: str, w, step: int, times: int) -> Column:
    """Sum of a rolling sum and its predecessors ``step`` rows apart: ``times`` blocks end to end.

    Long windows are built from short ones this way; no difference of running totals is taken,
    which would lose the digits of small prices behind large ones.
    """
    return sum((F.coalesce(F.lag(c, step * i).over(w), F.lit(0.0)) for i in range(1, times)), F.col(c))


def change(c: str | Column, w, rows: int) -> Column:
    """Relative change over ``rows`` rows."""
    x = F.col(c) if isinstance(c, str) else c
    return ratio(x, F.lag(x, rows).over(w)) - 1


def difference(c: str, w, rows: int) -> Column:
    return F.col(c) - F.lag(c, rows).over(w)


def log_change(c: str, w) -> Column:
    """Log of the ratio to the row before; both must be positive."""
    x, before = F.col(c), F.lag(c, 1).over(w)
    return F.when((x > 0) & (before > 0), F.log(x / before))


def rolling_mean(c: str | Column, w, rows: int, at_least: int) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(f) >= at_least, F.avg(x).over(f))


def std_of_sums(n: Column, total: Column, squares: Column, at_least: int) -> Column:
    """Sample deviation from count, sum and sum of squares; for values that scatter around zero,
    like log changes, where the difference keeps its digits."""
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    return F.when((n >= at_least) & (n > 1), F.sqrt(spread / (n - 1)))


def rolling_std(c: str, w, rows: int, at_least: int) -> Column:
    """Sample deviation of the last ``rows`` rows."""
    f = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(f) >= at_least, F.stddev_samp(c).over(f))
