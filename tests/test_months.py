"""Tables of monthly sums that a stream keeps up to date."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import series
from tallyloom.sources.tables import from_star
from tallyloom.streaming import monthly


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    return monthly.MonthTable(spark, f"file://{tmp_path}/months", monthly.DISPENSED)


DAY = dt.date(2025, 9, 30)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "icode string, vstdate date, qty double")


def test_a_stream_keeps_the_table(spark, sf_dir, tmp_path, table):
    """Each file a batch; the stream stops and goes on; sums equal those over all records."""
    records = from_star(spark, sf_dir).dispense.selectExpr("icode", "cast(vstdate as date) as vstdate", "qty")
    for part in range(3):
        records.where(F.pmod(F.xxhash64("icode", "vstdate", "qty"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        table.keep(stream, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    want = series.dispensed(records)
    assert table._folders()["batch"] == [0, 1, 2]
    assert rows_of(table.read()) == rows_of(want.select("icode", "fy", "month_idx", "qty"))
    assert rows_of(table.read(1998)) == rows_of(series.dispensed(records, 1998).select("icode", "fy", "month_idx", "qty"))
    assert "PartitionFilters: [isnotnull(fy" in plan(table.read(1998))
    assert {p for f in table.read(1998).inputFiles() for p in f.split("/") if p.startswith("fy=")} >= {"fy=1998"}


def test_a_batch_counts_once(spark, table):
    first, second = batch(spark, ("a", DAY, 1.5), ("a", DAY, 2.25), ("b", dt.date(2025, 10, 1), 1.0)), batch(spark, ("a", DAY, 0.25), (None, DAY, 4.0), ("b", None, 9.0))
    table.add(first, 0)
    table.add(second, 1)
    want = {("a", 2025, 11, 4.0), ("b", 2026, 0, 1.0), (None, 2025, 11, 4.0)}
    assert {tuple(r) for r in table.read().collect()} == want
    table.add(second, 1)  # run again
    table.add(first, 0)
    assert {tuple(r) for r in table.read().collect()} == want
    assert table.fold() == 1 and table.fold() == 1
    table.add(second, 1)  # run again after it has been folded
    assert table._folders() == {"base": [1], "batch": [0, 1]}
    assert {tuple(r) for r in table.read().collect()} == want
    table.add(batch(spark, ("a", DAY, 6.0)), 2)
    want = want - {("a", 2025, 11, 4.0)} | {("a", 2025, 11, 10.0)}
    assert {tuple(r) for r in table.read().collect()} == want
    assert table.drop_folded() == 2 and table.fold() == 2 and {tuple(r) for r in table.read().collect()} == want
    assert table._folders() == {"base": [1, 2], "batch": [2]}


def test_a_batch_that_fails_half_way(spark, table, tmp_path):
    """Files without a finished folder count nowhere until the batch is run again."""
    table.add(batch(spark, ("a", DAY, 1.0)), 0)
    broken = batch(spark, ("a", DAY, 5.0)).selectExpr("icode", "vstdate", "if(qty > 0, raise_error('lost'), qty) as qty")
    with pytest.raises(Exception, match="lost"):
        table.add(broken, 1)
    assert rows_of(table.read()) == [("a", 2025, 11, 1.0)]
    table.add(batch(spark, ("a", DAY, 5.0)), 1)
    assert rows_of(table.read()) == [("a", 2025, 11, 6.0)]


def test_empty_batches_and_tables(spark, table):
    with pytest.raises(LookupError):
        table.read()
    assert table.fold() == -1 and table.drop_folded() == 0
    table.add(batch(spark), 0)
    assert table.read().count() == table.read(2025).count() == 0 and table.fold() == 0


def test_any_split_into_batches_gives_the_same(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([20250930, 20251001, 0, None, 20260228]), r.choice([0.1, 0.2, None]), round(r.random(), 2)) for _ in range(300)]
    kind = "working_code string, receive_date int, qty_order double, value double"
    every = []
    for n in (1, 7):
        table = monthly.MonthTable(spark, f"file://{tmp_path}/m{n}", monthly.PURCHASED)
        for i in range(n):
            table.add(spark.createDataFrame(rows[i::n], kind), i)
            if i == 3:
                table.fold()
        every.append(rows_of(table.read()))
    heads = spark.createDataFrame([(i, x[1]) for i, x in enumerate(rows)], "invoice_no long, receive_date int")
    lines = spark.createDataFrame([(i, x[0], x[2], x[3]) for i, x in enumerate(rows)], "invoice_no long, working_code string, qty_order double, value double")
    assert every[0] == every[1] == rows_of(series.purchased(heads, lines).select("working_code", "fy", "month_idx", "qty", "value"))


def test_tasks_follow_the_number_of_records(spark, sf_dir, monkeypatch):
    """Sums of months and vectors are made in as many tasks as the records ask for, whatever Spark joins by compressed bytes."""
    from tallyloom.operators import reconcile, series, trend
    from tallyloom.plans import queries
    from tallyloom.sources import tables

    x = tables.from_star(spark, sf_dir)
    n, m = x.dispense.count(), x.lines.count()
    assert tables.tasks_for(x.dispense, rows=n) == 1 and tables.tasks_for(x.dispense, x.lines, rows=100) == -(-(n + m) // 100)
    assert tables.tasks_for(x.dispense.where("false")) == 1
    count = lambda df: df.rdd.getNumPartitions()
    assert count(trend.month_grid(series.dispensed(x.dispense), ["icode", "fy"], ["qty"], 7)) == 7
    for module in (reconcile, queries):
        monkeypatch.setattr(module, "tasks_for", lambda *_, **__: 9)
    assert count(reconcile.linked_series(x)) == 9
    assert [count(queries.QUERIES[q](x)) for q in ("moving_average", "month_share", "months_reordered", "stock_curve", "reconcile_flags")] == [9] * 5
    monkeypatch.setattr(queries, "_LAID_OUT", {})
    queries.queries()["h_years_by_year"](spark, sf_dir)
    (path,) = queries._LAID_OUT.values()
    assert spark.read.parquet(f"{path}/layout").first()["buckets"] == 9


def test_links_are_dealt_by_the_number_of_rows(spark, sf_dir, monkeypatch):
    from tallyloom.plans import queries
    from tallyloom.sources import tables

    monkeypatch.setattr(queries, "tasks_for", lambda *_, **__: 9)
    x = tables.from_star(spark, sf_dir)
    assert [queries.QUERIES[q](x).rdd.getNumPartitions() for q in ("mapping_exclude", "mapping_upsert", "mapping_checked")] == [9] * 3
