"""Monthly series over a fiscal year, for one code or all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fiscal
from tallyloom.functions.numbers import exact
from tallyloom.sources.tables import one_name


def dispensed(dispense: DataFrame, fiscal_year: int | None = None, icode: str | None = None) -> DataFrame:
    """(icode, fy, month_idx, qty): months with records only. Filters stand on raw columns and reach the scan."""
    rows = dispense
    if fiscal_year is not None:
        rows = fiscal.of_year(rows, fiscal.in_dates(F.col("vstdate"), fiscal_year), fiscal_year)
    if icode is not None:
        rows = rows.where(F.col("icode") == icode)
    return rows.groupBy("icode", fiscal.year_of_date(F.col("vstdate")).alias("fy"), fiscal.month_index(F.month("vstdate")).alias("month_idx")).agg(F.coalesce(F.sum(exact(F.col("qty"))).cast("double"), F.lit(0.0)).alias("qty"))


def received(headers: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    """(invoice_no, fy, month_idx) of invoices that were received."""
    rows = headers.where("receive_date > 0")
    if fiscal_year is not None:
        rows = fiscal.of_year(rows, fiscal.in_ints(F.col("receive_date"), fiscal_year), fiscal_year)
        if "receive_day" in headers.columns:  # the same range on the stored column, for the scan
            rows = rows.where(fiscal.in_dates(F.col("receive_day"), fiscal_year))
    day = F.col("receive_date")
    return rows.select("invoice_no", fiscal.year_of_int(day).alias("fy"), fiscal.month_index(fiscal.month_of_int(day)).alias("month_idx"))


def received_lines(headers: DataFrame, lines: DataFrame, fiscal_year: int | None = None) -> DataFrame:
    """lines with fy and month_idx of their invoice. Lines laid out by `fy` meet the invoice of that year only."""
    heads = received(headers, fiscal_year)
    if "fy" not in lines.columns:
        return lines.join(heads, "invoice_no")
    mine = lines.withColumnRenamed("fy", "laid_out")
    if fiscal_year is not None:
        mine = mine.where(F.col("laid_out") == fiscal_year)
    # the year is compared beside the key, not as part of it: the two sides are bucketed by invoice alone
    same = (mine["invoice_no"] == heads["invoice_no"]) & (mine["laid_out"] - heads["fy"] == 0)
    return mine.join(heads, same).drop(heads["invoice_no"]).drop("laid_out")


def purchased(headers: DataFrame, lines: DataFrame, fiscal_year: int | None = None, working_code: str | None = None) -> DataFrame:
    """(working_code, fy, month_idx, qty, value): months with records only."""
    rows = lines if working_code is None else lines.where(F.col("working_code") == working_code)
    sums = [F.coalesce(F.sum(exact(F.coalesce(F.col(c), F.lit(0.0)))).cast("double"), F.lit(0.0)).alias(n) for c, n in (("qty_order", "qty"), ("value", "value"))]
    return received_lines(headers, rows, fiscal_year).groupBy("working_code", "fy", "month_idx").agg(*sums)


def vector(amount: str) -> Column:
    """Aggregate: 12 slots in fiscal order, 0.0 where a month has no row."""
    at = F.map_from_entries(F.collect_list(F.struct("month_idx", amount)))
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)))


def last_peak(values: Column) -> Column:
    """Position 0..11 of the largest slot; the last of equal ones."""
    return F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))["i"]


def dispensed_vectors(dispense: DataFrame, items: DataFrame, fiscal_year: int, icode: str | None = None) -> DataFrame:
    """(icode, name, monthly_qty, total), largest total first."""
    return item_vectors(dispensed(dispense, fiscal_year, icode), items)


def item_vectors(months: DataFrame, items: DataFrame) -> DataFrame:
    """The same of a year's months (icode, month_idx, qty), from wherever they are kept."""
    out = months.groupBy("icode").agg(vector("qty").alias("monthly_qty"), F.sum(exact(F.col("qty"))).cast("double").alias("total"))
    return with_item_name(out, items).select("icode", "name", "monthly_qty", "total").orderBy(F.desc("total"), "icode")


def purchased_vectors(headers: DataFrame, lines: DataFrame, catalog: DataFrame, fiscal_year: int, working_code: str | None = None) -> DataFrame:
    """(working_code, name, monthly_qty, total_qty, monthly_value, total_value, peak_fiscal_month)."""
    out = _code_sums(purchased(headers, lines, fiscal_year, working_code))
    if working_code is not None:  # asked for by itself, a code without purchases has a year of zeros
        zeros = F.array_repeat(F.lit(0.0), 12)
        asked = headers.sparkSession.range(1).select(F.lit(working_code).alias("working_code"))
        out = asked.join(out, "working_code", "left").select("working_code", *[F.coalesce(c, zeros if c.startswith("m") else F.lit(0.0)).alias(c) for c in ("monthly_qty", "total_qty", "monthly_value", "total_value")])
    return _with_peak(out, catalog)


def code_vectors(months: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same of a year's months (working_code, month_idx, qty, value), from wherever they are kept."""
    return _with_peak(_code_sums(months), catalog)


def _code_sums(months: DataFrame) -> DataFrame:
    return months.groupBy("working_code").agg(
        vector("qty").alias("monthly_qty"), F.sum(exact(F.col("qty"))).cast("double").alias("total_qty"),
        vector("value").alias("monthly_value"), F.sum(exact(F.col("value"))).cast("double").alias("total_value"),
    )


def _with_peak(sums: DataFrame, catalog: DataFrame) -> DataFrame:
    return with_catalog_name(sums, catalog).select("working_code", "name", "monthly_qty", "total_qty", "monthly_value", "total_value", (last_peak(F.col("monthly_value")) + 1).alias("peak_fiscal_month"))


def with_item_name(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows with `name`: the item's, or its code where that is missing or empty."""
    names = one_name(items.select("icode", "name"), "icode", "name")
    return rows.join(names, "icode", "left").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "icode"))


def with_catalog_name(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with `name`: the catalog's, trimmed; '' where missing."""
    names = one_name(catalog.select("working_code", F.col("drug_name").alias("name")), "working_code", "name")
    return rows.join(names, "working_code", "left").withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
