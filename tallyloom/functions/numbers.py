"""Ratios that may be undefined, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coverage outside of this is worth a warning.
COVERAGE = (0.75, 1.25)


def exact(amount: Column) -> Column:
    """For sums that do not depend on the order of rows."""
    return amount.cast("decimal(18,2)")


def total(amount: Column) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(exact(amount)).cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def variation(values: Column) -> Column:
    """Aggregate: population standard deviation over mean, null for a zero mean."""
    return F.stddev_pop(values) / F.nullif(F.avg(values), F.lit(0.0))


def coverage_warning(coverage: Column) -> Column:
    return F.coalesce((coverage < COVERAGE[0]) | (coverage > COVERAGE[1]), F.lit(False))


def number_text(value: Column, decimals: int = 2) -> Column:
    """Thousands grouped, at most so many decimals, no trailing zeros."""
    text = F.format_number(value, decimals)
    return F.regexp_replace(text, r"(?:\.0+|(\.[0-9]*?[1-9])0+)$", "$1") if decimals else text


def quantity_text(value: Column) -> Column:
    return number_text(value, 2)


def baht_text(value: Column, decimals: int = 0) -> Column:
    return F.concat(F.lit("฿"), number_text(value, decimals))


def signed_text(value: Column) -> Column:
    """A stock level: + before a surplus."""
    return F.concat(F.when(value > 0, "+").otherwise(""), quantity_text(value))


def axis_step(rough: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, near a rough step."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(rough, F.lit(1e-9)))))
    lead = rough / power
    return power * F.when(lead < 1.5, 1.0).when(lead < 3.0, 2.0).when(lead < 7.0, 5.0).otherwise(10.0)


def axis_label(value: Column) -> Column:
    return F.when(value >= 1000, F.format_string("%.1fK", value / 1000)).otherwise(F.round(value).cast("long").cast("string"))
