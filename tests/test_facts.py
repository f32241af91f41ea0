"""Facts laid out by fiscal year: what their plans read and move."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fiscal
from tallyloom.operators import reconcile, series, summary
from tallyloom.sources import facts, scratch
from tallyloom.sources.tables import from_star

YEAR = 1998


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    return from_star(spark, sf_dir)


@pytest.fixture(scope="module")
def laid(spark, star):
    path = scratch.folder(spark, "facts")
    facts.write(star, path, 4)
    return facts.bind(star, path)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(df):
    """Years of the files that the scans of a plan list, as partition folders."""
    return {part for f in df.inputFiles() for part in f.split("/") if part.startswith("fy=")}


def equal(a, b):
    columns = [F.col(c) if t != "array<double>" else F.transform(c, lambda v: F.round(v, 6)).alias(c) for c, t in b.dtypes]
    a, b = a.select(*columns), b.select(*columns)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_years_come_without_a_scan(star, laid):
    for mine, theirs in (
        (summary.dispense_years(laid.dispense, laid.dispense_years), summary.dispense_years(star.dispense)),
        (summary.purchase_years(laid.headers, laid.purchase_years), summary.purchase_years(star.headers)),
        (summary.merged_years(laid.dispense, laid.headers, YEAR, (laid.dispense_years, laid.purchase_years)), summary.merged_years(star.dispense, star.headers, YEAR)),
    ):
        assert "Scan" not in plan(mine).replace("LocalTableScan", "") and not mine.inputFiles()
        assert [r.fy for r in mine.collect()] == [r.fy for r in theirs.collect()]


def test_a_year_reads_its_partition(laid):
    one = summary.dispense_summary(laid.dispense, YEAR)
    assert "PartitionFilters: [isnotnull(fy" in plan(one)
    first, end = fiscal.date_window(YEAR)
    read = laid.dispense.where((F.col("fy") == YEAR) & (F.col("vstdate") >= first) & (F.col("vstdate") < end))
    assert files(read) == {f"fy={YEAR}"} and len(files(laid.dispense)) > 3
    assert plan(summary.purchase_summary(laid.headers, laid.lines, YEAR)).count("PartitionFilters: [isnotnull(fy") == 2


def test_join_of_lines_moves_nothing(laid, no_broadcast):
    """The only exchange of a year's purchases is that of the month aggregate."""
    for year in (YEAR, None):
        text = plan(series.purchased(laid.headers, laid.lines, year))
        assert "SortMergeJoin" in text and text.count("Exchange") == 1
        above, below = text.split("SortMergeJoin", 1)
        assert "Exchange" in above and "Exchange" not in below and "Bucketed: true" in below


def test_same_results(star, laid, no_broadcast):
    equal(series.purchased(laid.headers, laid.lines), series.purchased(star.headers, star.lines))
    equal(series.dispensed(laid.dispense, YEAR, "7"), series.dispensed(star.dispense, YEAR, "7"))
    equal(summary.purchase_summary(laid.headers, laid.lines, YEAR), summary.purchase_summary(star.headers, star.lines, YEAR))
    equal(reconcile.headline(reconcile.reconcile_links(laid, YEAR)), reconcile.headline(reconcile.reconcile_links(star, YEAR)))


def test_odd_rows(spark, star):
    """Missing dates and invoices, invoices of several years and repeated ones, lines without value, one invoice with most lines."""
    day = lambda y, m, d: dt.date(y, m, d)
    heads = [("a", 20250930), ("a", 20251001), ("b", 20251001), ("b", 20251001), ("c", 0), ("d", None), (None, 20251001), ("hot", 20251105)]
    lines = [("a", "W1", 1.0, 10.0), ("a", "W1", 2.0, -3.0), ("b", "W1", 3.0, None), ("b", None, None, 5.0), ("c", "W2", 1.0, 1.0), ("x", "W2", 1.0, 1.0), (None, "W2", 1.0, 1.0)] + [("hot", f"W{i % 3}", 1.0, 0.25 * (i % 5 - 1)) for i in range(500)]
    gave = [("1", day(2025, 9, 30), 1.0), ("1", day(2025, 10, 1), 2.0), ("1", None, 9.0), (None, day(2025, 10, 1), 3.0)]
    x = type(star)(
        spark.createDataFrame(gave, "icode string, vstdate date, qty double"), star.items, spark.createDataFrame(heads, "invoice_no string, receive_date int"),
        spark.createDataFrame(lines, "invoice_no string, working_code string, qty_order double, value double"), star.catalog, star.links, star.exclusions,
    )
    path = scratch.folder(spark, "facts")
    facts.write(x, path, 3)
    laid = facts.bind(x, path)
    for year in (None, 2025, 2026, 2030):
        equal(series.purchased(laid.headers, laid.lines, year), series.purchased(x.headers, x.lines, year))
        equal(series.dispensed(laid.dispense, year), series.dispensed(x.dispense, year))
        if year:
            equal(summary.purchase_summary(laid.headers, laid.lines, year), summary.purchase_summary(x.headers, x.lines, year))
    assert [r.fy for r in summary.purchase_years(laid.headers, laid.purchase_years).collect()] == [2026, 2025]
    assert laid.lines.where("invoice_no = 'hot'").count() <= 6
    rows = laid.lines.count()
    facts.write(x, path, 3)  # over what is there
    assert facts.bind(x, path).lines.count() == rows
