"""Years with data, year summaries and the largest items of a year; each a single pass over the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fiscal
from tallyloom.functions.numbers import exact
from tallyloom.operators import series


def dispense_years(dispense: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """known: the years that a layout knows; then no fact is read."""
    if known is not None:
        return known.orderBy(F.desc("fy"))
    return dispense.select(fiscal.year_of_date(F.col("vstdate")).alias("fy")).where("fy > 0").distinct().orderBy(F.desc("fy"))


def purchase_years(headers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    if known is not None:
        return known.orderBy(F.desc("fy"))
    return headers.where("receive_date > 0").select(fiscal.year_of_int(F.col("receive_date")).alias("fy")).where("fy > 0").distinct().orderBy(F.desc("fy"))


def merged_years(dispense: DataFrame, headers: DataFrame, selected: int | None = None, known: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """Years of either side, newest first; the selected one alone where there is no data."""
    both = dispense_years(dispense, known[0]).union(purchase_years(headers, known[1])).distinct()
    if selected is not None:
        alone = dispense.sparkSession.range(1).select(F.lit(selected).cast("int").alias("fy"))
        both = both.union(alone.join(both.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))
    return both.orderBy(F.desc("fy"))


def dispense_summary(dispense: DataFrame, fiscal_year: int) -> DataFrame:
    """(total_qty, unique_drug_count), one row."""
    rows = fiscal.of_year(dispense, fiscal.in_dates(F.col("vstdate"), fiscal_year), fiscal_year)
    return rows.groupBy("icode").agg(F.sum(exact(F.col("qty"))).alias("q")).agg(F.coalesce(F.sum("q").cast("double"), F.lit(0.0)).alias("total_qty"), F.count("icode").alias("unique_drug_count"))


def purchase_summary(headers: DataFrame, lines: DataFrame, fiscal_year: int) -> DataFrame:
    """(total_value, unique_drug_count, peak_fiscal_month, peak_value), one row; codes count where a line has a value above 0.

    Lines and headers are read once: a row for each code holds its twelve sums, and these add up to the one row. The
    last of equal months is the peak, and 12 with 0 if there is no data.
    """
    rows = series.received_lines(headers, lines, fiscal_year)
    value = exact(F.coalesce("value", F.lit(0.0)))
    by_code = rows.groupBy("working_code").agg(*[F.sum(F.when(F.col("month_idx") == i, value)).alias(f"v{i}") for i in range(12)], F.max(F.col("value") > 0).alias("bought"))
    bought = F.col("bought") & F.col("working_code").isNotNull()
    one = by_code.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0).cast("decimal(18,2)")).alias(f"v{i}") for i in range(12)], F.count(F.when(bought, 1)).alias("unique_drug_count"))
    one = one.select("unique_drug_count", sum(F.col(f"v{i}") for i in range(12)).cast("double").alias("total_value"), F.array(*[F.col(f"v{i}").cast("double") for i in range(12)]).alias("v"))
    return one.select("total_value", "unique_drug_count", (series.last_peak(F.col("v")) + 1).alias("peak_fiscal_month"), F.array_max("v").alias("peak_value"))


def top_dispensed(dispense: DataFrame, items: DataFrame, fiscal_year: int, n: int) -> DataFrame:
    """(icode, name, total_qty, peak_calendar_month): the largest totals; ties by code. Totals and peaks come from one pass."""
    months = series.dispensed(dispense, fiscal_year)
    top = months.groupBy("icode").agg(F.sum(exact(F.col("qty"))).cast("double").alias("total_qty"), series.vector("qty").alias("v")).orderBy(F.desc("total_qty"), "icode").limit(n)
    calendar = F.concat(F.slice("v", 4, 9), F.slice("v", 1, 3))
    out = top.select("icode", "total_qty", (series.last_peak(calendar) + 1).alias("peak_calendar_month"))
    return series.with_item_name(out, items).select("icode", "name", "total_qty", "peak_calendar_month").orderBy(F.desc("total_qty"), "icode")


def top_purchased(headers: DataFrame, lines: DataFrame, catalog: DataFrame, fiscal_year: int, n: int) -> DataFrame:
    """(working_code, name, total_value, peak_fiscal_month, peak_value): the largest totals; ties by code."""
    months = series.purchased(headers, lines, fiscal_year)
    top = months.groupBy("working_code").agg(F.sum(exact(F.col("value"))).cast("double").alias("total_value"), series.vector("value").alias("v")).orderBy(F.desc("total_value"), "working_code").limit(n)
    out = top.select("working_code", "total_value", (series.last_peak(F.col("v")) + 1).alias("peak_fiscal_month"), F.array_max("v").alias("peak_value"))
    return series.with_catalog_name(out, catalog).select("working_code", "name", "total_value", "peak_fiscal_month", "peak_value").orderBy(F.desc("total_value"), "working_code")
