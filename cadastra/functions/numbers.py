"""Numeric and date Column helpers shared by every operator."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(value: str | dt.date | Column) -> Column:
    """An ISO string, a date or a Column as a DATE Column."""
    if isinstance(value, Column):
        return value
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def half_up(c: Column | str, dp: int = 0) -> Column:
    """Round with .5 going towards plus infinity, as the published figures do.

    From 2^53 units of the last place on a double holds no digits to round, and stays.
    """
    scale = float(10**dp)
    x = as_col(c).cast("double")
    if isinstance(c, str):
        x = F.expr(f"CAST(`{c}` AS DOUBLE)")
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(x) >= F.lit(2.0**53 / scale), x).otherwise(rounded)


def exact(c: Column | str) -> Column:
    """An amount as a decimal that adds up exactly; one that no decimal can hold stops the query instead of missing from its sum."""
    x = as_col(c)
    amount = x.cast("double")
    # The comparison is false for NaN and the infinities too.
    return F.when(x.isNull() | (F.abs(amount) < F.lit(1e22)), x.cast("decimal(32,10)")).otherwise(
        F.raise_error(F.concat(F.lit("not an amount: "), amount.cast("string"))).cast("decimal(32,10)"))


def total(c: Column | str, dp: int = 2) -> Column:
    """Exact sum of an amount, rounded half up to ``dp`` places.

    Amounts are added as decimals, so neither partition order nor size shows in the result. Digits
    beyond the places that amounts carry are settled first, so an amount that a
    double holds a hair below a half still rounds up.
    """
    settled = F.round(F.sum(exact(c)), dp + 4)
    return F.floor(settled + F.lit(Decimal(5).scaleb(-dp - 1)), F.lit(dp)).cast("double")


def mean(c: Column | str, dp: int = 0) -> Column:
    """Rounded mean built on the settled sum."""
    return half_up(total(c) / F.nullif(F.count(as_col(c)), F.lit(0)), dp)


def count_where(cond: Column) -> Column:
    """Number of rows where the condition is true; 0 for none, never null."""
    return F.count_if(cond)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is null or zero."""
    return as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0))


def quotient(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles have it: infinite where b is zero, not a number where both are, so one such row stops no query."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def share(a: Column | str, b: Column | str, dp: int = 0) -> Column:
    """100 * a / b, rounded."""
    return half_up(F.lit(100.0) * as_col(a) / F.nullif(as_col(b).cast("double"), F.lit(0.0)), dp)


def pct_change(a: Column | str, b: Column | str, dp: int = 1) -> Column:
    """Percent change from b to a; null when either side is null or zero."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.when((a != 0) & (b != 0), half_up(F.lit(100.0) * (a / b - F.lit(1.0)), dp))


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "MM")


def month_label(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def quarter_index(c: Column | str) -> Column:
    """Quarters since year 0, so neighbours differ by one."""
    return F.year(as_col(c)) * 4 + F.quarter(as_col(c)) - 1


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.year(as_col(c)).cast("string"), F.lit("Q"), F.quarter(as_col(c)).cast("string"))


def months_apart(a: Column, b: Column) -> Column:
    """Whole months from a to b counted on year and month only."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def between_days(c: Column | str, start, end) -> Column:
    """Inclusive date window; either end may be open (None)."""
    c = as_col(c)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= day(start))
    if end is not None:
        cond = cond & (c <= day(end))
    return cond


def days_before(as_of, n: int) -> Column:
    return F.date_sub(day(as_of), n)


def settle(c: Column | str, dp: int = 0) -> Column:
    """Round an order statistic, first freeing it of the last binary digit of averaging two middles."""
    return half_up(half_up(c, 4), dp)
