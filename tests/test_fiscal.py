import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions import fiscal


def test_month_index_and_back(spark):
    rows = spark.createDataFrame([(m,) for m in (10, 11, 12, 1, 2, 9)], "m int").select("m", fiscal.month_index(F.col("m")).alias("i"))
    assert [(r.m, r.i) for r in rows.collect()] == [(10, 0), (11, 1), (12, 2), (1, 3), (2, 4), (9, 11)]
    assert all(r.m == r.c for r in rows.select("m", fiscal.calendar_month(F.col("i")).alias("c")).collect())


# The months and years of FIXTURES.md section 2.


def test_fiscal_order(spark):
    row = spark.createDataFrame([([10, 20, 30, 40, 50, 60, 70, 80, 90, 1, 2, 3],)], "a array<int>").select(fiscal.to_fiscal_order(F.col("a"))).first()
    assert row[0] == [1, 2, 3, 10, 20, 30, 40, 50, 60, 70, 80, 90]


def test_windows():
    assert fiscal.int_window(2026) == (20251001, 20260930)
    assert fiscal.date_window(2026) == (dt.date(2025, 10, 1), dt.date(2026, 10, 1))


def test_years(spark):
    rows = spark.createDataFrame([(20250930, dt.date(2025, 9, 30)), (20251001, dt.date(2025, 10, 1)), (20241231, dt.date(2024, 12, 31)), (20250101, dt.date(2025, 1, 1))], "i int, d date")
    got = rows.select(fiscal.year_of_int(F.col("i")).alias("a"), fiscal.year_of_date(F.col("d")).alias("b"), fiscal.in_ints(F.col("i"), 2026).alias("c"), fiscal.in_dates(F.col("d"), 2026).alias("e")).collect()
    assert [tuple(r) for r in got] == [(2025, 2025, False, False), (2026, 2026, True, True), (2025, 2025, False, False), (2025, 2025, False, False)]


def test_timestamps_at_the_edge_of_a_year(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, 9, 30, 23, 59),), (dt.datetime(2026, 10, 1),)], "t timestamp").select(fiscal.in_dates(F.col("t"), 2026))
    assert [r[0] for r in rows.collect()] == [True, False]


def test_default_year():
    assert fiscal.default_year([2024, 2025], 2025) == 2025
    assert fiscal.default_year([2024, 2025], 2020) == 2025
    assert fiscal.default_year([], 2020) == 2020


def test_labels(spark):
    assert [r[0] for r in spark.range(12).select(fiscal.month_label(F.col("id").cast("int"))).collect()] == fiscal.MONTH_LABELS


def test_current_year(spark):
    now = spark.range(1).select(fiscal.current_year().alias("y"), F.current_date().alias("d")).first()
    assert now.y == now.d.year + (now.d.month >= 10)
