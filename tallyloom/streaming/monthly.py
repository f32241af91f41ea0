"""Monthly totals over a stream of records, with the same columns as the batch series: as a stream, or kept in a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fiscal
from tallyloom.functions.numbers import exact

#: Sums in a table.
SUM = "decimal(38,2)"


def monthly_totals(records: DataFrame) -> DataFrame:
    """(icode, fy, month_idx, qty) of a stream (icode, vstdate, qty), for output modes update and complete.

    State is a row for each code and month.
    """
    months = records.groupBy("icode", F.trunc("vstdate", "month").alias("month")).agg(F.sum(exact(F.col("qty"))).cast("double").alias("qty"))
    return months.select("icode", fiscal.year_of_date(F.col("month")).alias("fy"), fiscal.month_index(F.month("month")).alias("month_idx"), "qty")


def daily_totals(records: DataFrame, lateness: str = "62 days") -> DataFrame:
    """(icode, day, qty), appended once the watermark has passed a day; later records are dropped and state is freed."""
    rows = records.withColumn("at", F.col("vstdate").cast("timestamp")).withWatermark("at", lateness)
    days = rows.groupBy("icode", F.window("at", "1 day").alias("w")).agg(F.sum(exact(F.col("qty"))).cast("double").alias("qty"))
    return days.select("icode", F.col("w.start").cast("date").alias("day"), "qty")


@dataclass(frozen=True)
class Months:
    """What a table of monthly sums is kept by: the code, the day (a date, or a YYYYMMDD integer), and the amounts with the names of their sums."""

    key: str
    day: str
    amounts: dict[str, str]

    def sums(self, rows: DataFrame) -> DataFrame:
        """(key, fy, month_idx, sums) of records; decimal sums, so that they do not depend on how records come in batches. Days that are missing or not positive count nowhere."""
        day = F.col(self.day)
        if isinstance(rows.schema[self.day].dataType, T.IntegralType):
            rows, fy, month = rows.where(day > 0), fiscal.year_of_int(day), fiscal.month_of_int(day)
        else:
            rows, fy, month = rows.where(day.isNotNull()), fiscal.year_of_date(day), F.month(day)
        made = [F.sum(exact(F.coalesce(F.col(c), F.lit(0.0)))).cast(SUM).alias(n) for c, n in self.amounts.items()]
        return rows.groupBy(self.key, fy.alias("fy"), fiscal.month_index(month).alias("month_idx")).agg(*made)


DISPENSED = Months("icode", "vstdate", {"qty": "qty"})
PURCHASED = Months("working_code", "receive_date", {"qty_order": "qty", "value": "value"})


class MonthTable:
    """Monthly sums that a stream keeps up to date.

    A batch of the stream becomes a folder `batch=<id>` of its own sums, partitioned by fiscal year. A batch that is run
    again finds its folder finished and changes nothing, or writes over what a failure has left of it: each batch counts
    once. `fold` sums the batches up to some id into a folder `base=<id>`; once that is complete, readers take it
    in place of these batches. Reading adds up the base and the batches after it, a few rows a code and month each, and a
    year's query opens that year's folders only. Ids belong to one checkpoint: a stream that starts anew needs a new table.
    """

    def __init__(self, spark: SparkSession, path: str, months: Months):
        self.spark, self.path, self.months = spark, path.rstrip("/"), months
        self._schema = f"{months.key} string, month_idx int, {', '.join(f'{n} {SUM}' for n in months.amounts.values())}, fy int"

    def _folders(self) -> dict[str, list[int]]:
        """Ids of the finished folders of each kind."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out: dict[str, list[int]] = {"base": [], "batch": []}
        for status in fs.listStatus(top) if fs.exists(top) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in out and number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out[kind].append(int(number))
        return {k: sorted(v) for k, v in out.items()}

    def _write(self, sums: DataFrame, folder: str) -> None:
        order = [self.months.key, "month_idx", *self.months.amounts.values(), "fy"]
        sums.select(F.col(self.months.key).cast("string"), *order[1:]).repartitionByRange("fy", self.months.key).write.partitionBy("fy").mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{folder}")

    def add(self, records: DataFrame, batch: int) -> None:
        """Adds the records of a batch; once, however often it is called with this id."""
        done = self._folders()
        if batch not in done["batch"] and batch > max(done["base"], default=-1):
            self._write(self.months.sums(records), f"batch={batch}")

    def keep(self, stream: DataFrame, checkpoint: str):
        """A writer that keeps the table by a stream of records; trigger and start it as any other."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)

    def _read(self, fiscal_year: int | None, upto: int | None = None) -> DataFrame:
        found = self._folders()
        base = found["base"][-1:]
        batches = [b for b in found["batch"] if (not base or b > base[0]) and (upto is None or b <= upto)]
        names = [f"base={b}" for b in base] + [f"batch={b}" for b in batches]
        parts = []
        for name in names:
            rows = self.spark.read.schema(self._schema).parquet(f"{self.path}/{name}")
            parts.append(rows.select(self.months.key, "fy", "month_idx", *self.months.amounts.values()))
        if not parts:
            raise LookupError(f"no batch has been added to {self.path}")
        rows = reduce(DataFrame.unionByName, parts)
        if fiscal_year is not None:
            rows = rows.where(F.col("fy") == fiscal_year)
        return rows.groupBy(self.months.key, "fy", "month_idx").agg(*[F.sum(n).cast(SUM).alias(n) for n in self.months.amounts.values()])

    def read(self, fiscal_year: int | None = None) -> DataFrame:
        """(key, fy, month_idx, sums): what series.dispensed or series.purchased give for all records added so far."""
        sums = [F.col(n).cast("double").alias(n) for n in self.months.amounts.values()]
        return self._read(fiscal_year).select(self.months.key, "fy", "month_idx", *sums)

    def fold(self, upto: int | None = None) -> int:
        """Sums the base and the batches up to an id (default: the newest) into a new base and returns its id; what it replaces stays until `drop_folded`."""
        found = self._folders()
        wanted = [b for b in found["batch"] if upto is None or b <= upto]
        if not wanted or (found["base"] and found["base"][-1] >= wanted[-1]):
            return found["base"][-1] if found["base"] else -1
        self._write(self._read(None, wanted[-1]), f"base={wanted[-1]}")
        return wanted[-1]

    def drop_folded(self) -> int:
        """Deletes what the newest base replaces and returns how many folders went. Only when no reader of before is at work."""
        found, jvm = self._folders(), self.spark.sparkContext._jvm
        if not found["base"]:
            return 0
        newest = found["base"][-1]
        old = [f"base={b}" for b in found["base"][:-1]] + [f"batch={b}" for b in found["batch"] if b <= newest]
        for name in old:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return len(old)
