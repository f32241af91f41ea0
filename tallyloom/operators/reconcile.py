"""Reconciliation of what was given out with what was bought, for all links and years in one job.

Both month tables are unioned under the link's key and summed into one row a (key, fiscal year) with two or three
12-slot vectors: a single shuffle after the month aggregates, no window, no join of the two sides. Rows of one month are
dealt before they become vectors, into tasks by the number of records, so a task's memory does not grow with the input.
Figures and flags are expressions on those vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import exact, ratio
from tallyloom.operators import links as link_ops
from tallyloom.operators import series
from tallyloom.sources.tables import tasks_for

FLAG = "struct<kind:string,month:int,gap:string,dispensed_qty:double,purchased_qty:double,purchased_value:double>"
# Kinds of flags in their order.
KINDS = ["zero-use-full-purchase", "dispensed-without-purchase", "unit-price-spike", "year-end-stock-gap"]


@dataclass(frozen=True)
class Thresholds:
    """A price above spike times the year's median; months with a value up to min_value have no price; a year-end residue above gap times what was given out."""

    spike: float = 3.0
    min_value: float = 0.0
    gap: float = 0.25


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("decimal(30,2)"), lambda a, x: (a + exact(x)).cast("decimal(30,2)")).cast("double")


def _variation(values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)
    return F.when((n > 0) & (mean != 0.0), spread / mean)


def _median(values: Column) -> Column:
    """Of the non-null slots: the middle one, or the mean of the middle two."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    middle = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.get(v, middle)).otherwise((F.get(v, middle - 1) + F.get(v, middle)) / 2.0)


def reconcile(rows: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """rows with dispensed_qty, purchased_qty and purchased_value (12 slots each), plus all figures and flags.

    Staged, so that each figure is computed once.
    """
    d, q, v = F.col("dispensed_qty"), F.col("purchased_qty"), F.col("purchased_value")
    price = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.when((F.get(v, m) > limits.min_value) & (F.get(q, m) > 0), F.get(v, m) / F.get(q, m)))
    out = rows.withColumns({
        "year_dispensed": _sum(d), "year_purchased_qty": _sum(q), "year_value": _sum(v),
        "purchase_price_month": price, "monthly_deltas": F.zip_with(q, d, lambda a, b: a - b),
    })
    running = F.aggregate("monthly_deltas", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0.0)) + x)))
    out = out.withColumns({
        "cumulative_deltas": running, "median_price": _median(F.col("purchase_price_month")),
        "unit_price_year": ratio(F.col("year_value"), F.col("year_dispensed")),
        "coverage_ratio": ratio(F.col("year_dispensed"), F.col("year_purchased_qty")),
        "cv_dispensed_qty": _variation(d), "cv_purchased_value": _variation(v),
    })
    return out.withColumn("flags", _flags(limits))


def _flag(when: Column, kind: str, month: Column | None, gap: Column | None, of: tuple[Column, Column, Column]) -> Column:
    none = F.lit(None)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), (none if month is None else month).cast("int").alias("month"), (none if gap is None else gap).cast("string").alias("gap"), of[0].alias("dispensed_qty"), of[1].alias("purchased_qty"), of[2].alias("purchased_value")))


def _flags(limits: Thresholds) -> Column:
    d, q, v = F.col("dispensed_qty"), F.col("purchased_qty"), F.col("purchased_value")
    used, bought, spent = F.col("year_dispensed"), F.col("year_purchased_qty"), F.col("year_value")
    year = (used, bought, spent)
    left, most = F.get("cumulative_deltas", 11), limits.gap * used
    median = F.col("median_price")

    def spike(m: Column) -> Column:
        p = F.get("purchase_price_month", m)
        high = F.when(median > 0, p > limits.spike * median).otherwise(p > 0)
        return _flag(F.coalesce(high, F.lit(False)), KINDS[2], m, None, (F.get(d, m), F.get(q, m), F.get(v, m)))

    whole = [
        _flag((used <= 0) & (spent > 0), KINDS[0], None, None, year),
        _flag((used > 0) & (spent <= 0), KINDS[1], None, None, year),
    ]
    gap = F.when(left > most, "overstock").when(left < -most, "overuse")
    last = _flag((used > 0) & gap.isNotNull(), KINDS[3], None, gap, year)
    found = F.concat(F.array(*whole), F.transform(F.sequence(F.lit(0), F.lit(11)), spike), F.array(last))
    return F.filter(found, lambda f: f.isNotNull()).cast(f"array<{FLAG}>")


def linked_series(inputs, fiscal_year: int | None = None, icode: str | None = None) -> DataFrame:
    """(icode, working_code, fy, dispensed_qty, purchased_qty, purchased_value) of links in force; years where either side has data."""
    link = link_ops.latest(inputs.links).select("icode", "working_code").hint("merge")
    if icode is not None:
        link = link.where(F.col("icode") == icode)
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    out = series.dispensed(inputs.dispense, fiscal_year, icode).join(link, "icode").select("icode", "working_code", "fy", "month_idx", F.col("qty").alias("d"), none.alias("q"), none.alias("v"))
    bought = series.purchased(inputs.headers, inputs.lines, fiscal_year).join(link, "working_code").select("icode", "working_code", "fy", "month_idx", none.alias("d"), F.col("qty").alias("q"), F.col("value").alias("v"))
    both = out.unionByName(bought).repartition(tasks_for(inputs.dispense, inputs.lines), "icode")
    # a side has one row a link and month, so a slot is that row's amount; the other side's rows are null there
    slots = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("month_idx") == i, F.col(c))), zero) for i in range(12)])
    return both.groupBy("icode", "working_code", "fy").agg(slots("d").alias("dispensed_qty"), slots("q").alias("purchased_qty"), slots("v").alias("purchased_value"))


def reconcile_links(inputs, fiscal_year: int | None = None, icode: str | None = None, limits: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    return reconcile(linked_series(inputs, fiscal_year, icode), limits)


def reconcile_one(inputs, fiscal_year: int, icode: str, limits: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """One row for one linked item, with zeros where a side has no data; raises LookupError if the item has no link."""
    link = link_ops.latest(inputs.links).where(F.col("icode") == icode).select("icode", "working_code", F.lit(fiscal_year).alias("fy"))
    if not link.limit(1).count():
        raise LookupError(f"{icode} has no link")
    found = linked_series(inputs, fiscal_year, icode).drop("working_code", "fy")
    zeros = F.array_repeat(F.lit(0.0), 12)
    filled = link.join(found, "icode", "left").select("icode", "working_code", "fy", *[F.coalesce(c, zeros).alias(c) for c in ("dispensed_qty", "purchased_qty", "purchased_value")])
    return reconcile(filled, limits)


def months(reconciled: DataFrame) -> DataFrame:
    """A row for each month: (icode, working_code, fy, month_idx, dispensed_qty, purchased_qty, purchased_value, price, delta, stock)."""
    zipped = F.arrays_zip("dispensed_qty", "purchased_qty", "purchased_value", "purchase_price_month", "monthly_deltas", "cumulative_deltas")
    flat = reconciled.select("icode", "working_code", "fy", F.posexplode(zipped).alias("month_idx", "m"))
    return flat.select(
        "icode", "working_code", "fy", "month_idx", "m.dispensed_qty", "m.purchased_qty", "m.purchased_value",
        F.col("m.purchase_price_month").alias("price"), F.col("m.monthly_deltas").alias("delta"), F.col("m.cumulative_deltas").alias("stock"),
    )


def flag_rows(reconciled: DataFrame) -> DataFrame:
    """A row for each flag, in order of kind and month by flag_no."""
    flat = reconciled.select("icode", "working_code", "fy", F.posexplode("flags").alias("flag_no", "f"))
    return flat.select("icode", "working_code", "fy", "flag_no", "f.*")


def headline(reconciled: DataFrame) -> DataFrame:
    """(icode, working_code, fy, totals, coverage warning, number of flags)."""
    from tallyloom.functions.numbers import coverage_warning

    return reconciled.select("icode", "working_code", "fy", "year_dispensed", "year_purchased_qty", "year_value", "unit_price_year", "coverage_ratio", coverage_warning(F.col("coverage_ratio")).alias("coverage_warning"), F.size("flags").alias("n_flags"))


def flag_texts(flags: DataFrame) -> DataFrame:
    """flags with the figures that their messages show: residue, overstock in percent, spike price."""
    d, q, v = F.col("dispensed_qty"), F.col("purchased_qty"), F.col("purchased_value")
    return flags.withColumns({
        "residue": F.when(F.col("gap") == "overstock", q - d).when(F.col("gap") == "overuse", d - q),
        "overstock_percent": F.when(F.col("gap") == "overstock", F.when(d > 0, (q / d - 1.0) * 100.0).otherwise(0.0)),
        "spike_price": F.when(F.col("kind") == KINDS[2], F.when(q > 0, v / q).otherwise(0.0)),
    })
