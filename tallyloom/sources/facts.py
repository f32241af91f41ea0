"""Facts laid out for queries by fiscal year: external tables partitioned by `fy`, invoices and their lines bucketed alike.

* Years with data are the partitions that the catalog knows: asking for them opens no file.
* A query of one year reads that year's partition; operators put the year's condition on `fy` where a table has it.
* Lines stand in the partition of their invoice's year. Both tables are bucketed and sorted by invoice, so the join of
  lines to headers moves no row. Lines of one invoice, code and sign of value are summed before they are written,
  which every operator does anyway: an invoice with very many lines has at most two rows a code in its bucket.
* Dispense rows are sorted by code within a year, so a query of one code skips most row groups. Ranges of year, code
  and day decide where a row is written, so neither a year nor a code is a hot key.

An invoice that was received in several years keeps its lines in each of them; lines without a received invoice and
dates that are missing stand in the partition of null, which no query reads.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import fiscal
from tallyloom.functions.numbers import exact
from tallyloom.sources.tables import Inputs

BUCKETS = 64
TABLES = {"dispense": None, "headers": "invoice_no", "lines": "invoice_no"}


def _table(path: str, name: str) -> str:
    """The catalog's name of a table: one for each place."""
    return f"facts_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}_{name}"


def _received_year(day: str = "receive_date") -> Column:
    return F.when(F.col(day) > 0, fiscal.year_of_int(F.col(day)))


def write(x: Inputs, path: str, buckets: int = BUCKETS) -> None:
    """Writes the three fact tables under a path, over what is there. buckets: as many as make a year's bucket fit a task."""
    spark = x.dispense.sparkSession
    out = x.dispense.select("icode", F.col("vstdate").cast("date").alias("vstdate"), "qty", fiscal.year_of_date(F.col("vstdate")).alias("fy"))
    out = out.repartitionByRange(buckets, "fy", "icode", "vstdate").sortWithinPartitions("fy", "icode", "vstdate")
    out.write.partitionBy("fy").mode("overwrite").parquet(f"{path}/dispense")
    headers = x.headers.select("invoice_no", "receive_date", _received_year().alias("fy"))
    bought = F.coalesce(F.col("value") > 0, F.lit(False))
    sums = [F.sum(exact(F.coalesce(F.col(c), F.lit(0.0)))).cast("double").alias(c) for c in ("qty_order", "value")]
    lines = x.lines.groupBy("invoice_no", "working_code", bought.alias("bought")).agg(*sums).drop("bought")
    # a task holds one bucket of every year, so a bucket of a year is one file; lines meet their years as they are dealt
    headers, lines = headers.repartition(buckets, "invoice_no"), lines.repartition(buckets, "invoice_no")
    years = headers.where("fy is not null").select("invoice_no", "fy").distinct()
    for name, rows in (("headers", headers), ("lines", lines.join(years.hint("merge"), "invoice_no", "left"))):
        dealt = rows.write.format("parquet").partitionBy("fy").bucketBy(buckets, "invoice_no").sortBy("invoice_no")
        spark.sql(f"DROP TABLE IF EXISTS {_table(path, name)}")
        dealt.mode("overwrite").option("path", f"{path}/{name}").saveAsTable(_table(path, name))
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def _bound(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """A table of the layout, declared anew so that the catalog knows the partitions that are there now."""
    table, key = _table(path, name), TABLES[name]
    schema = spark.read.parquet(f"{path}/{name}").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "fy")
    clustered = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # external: its files stay
    spark.sql(f"CREATE TABLE {table} ({columns}, fy INT) USING parquet PARTITIONED BY (fy) {clustered} LOCATION '{path}/{name}'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def _years(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The positive years among a table's partitions, as the catalog lists them."""
    year = F.regexp_extract("partition", r"fy=(-?\d{1,9})$", 1)
    return spark.sql(f"SHOW PARTITIONS {_table(path, name)}").where(year != "").select(year.cast("int").alias("fy")).where("fy > 0").distinct()


def bind(x: Inputs, path: str) -> Inputs:
    """x with its facts read from the layout at a path, and the years that it holds."""
    spark = x.items.sparkSession
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    tables = {name: _bound(spark, path, name, buckets) for name in TABLES}
    return replace(x, **tables, dispense_years=_years(spark, path, "dispense"), purchase_years=_years(spark, path, "headers"))
