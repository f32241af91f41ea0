"""Bulk import of links from CSV text: parsed records are classified against the links in force."""

from __future__ import annotations

import csv
import io
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of columns that make a header when both leading fields are among them.
HEADER_NAMES = ["icode", "working_code", "workingcode", "drug_name_hosxp", "drug_name_invs", "code", "name"]
_ROWS = "line int, physical_line int, icode string, working_code string, dispensed_name string, purchased_name string"


def parse(text: str) -> tuple[list[tuple[int, int, str, str, str, str]], list[tuple[int, str]]]:
    """(rows, errors) of pasted CSV text. Headers and blank records are skipped wherever they stand; a record of one field is an error.

    Rows carry their ordinal and the line they start on. Codes stay text, so leading zeros stay; fields may be of any
    length (the reader's limit is lifted while it reads, and put back).
    """
    limit = csv.field_size_limit(sys.maxsize)
    try:
        return _parse(text)
    finally:
        csv.field_size_limit(limit)


def _parse(text: str) -> tuple[list[tuple[int, int, str, str, str, str]], list[tuple[int, str]]]:
    rows, errors = [], []
    reader = csv.reader(io.StringIO(text, newline=""), skipinitialspace=True)
    done = 0
    while True:
        try:
            record = next(reader)
        except StopIteration:
            return rows, errors
        except csv.Error as e:
            errors.append((reader.line_num, f"line {reader.line_num}: {e}"))
            return rows, errors
        at, done = done + 1, reader.line_num
        fields = [f.strip() for f in record]
        if not any(fields):
            continue
        if len(fields) < 2:
            errors.append((at, f"line {at}: two columns are needed, icode and working_code"))
        elif not all(f.lower() in HEADER_NAMES for f in fields[:2]):
            fields += ["", ""]
            rows.append((len(rows) + 1, at, *fields[:4]))


def read(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of pasted text as tables."""
    rows, errors = parse(text)
    return spark.createDataFrame(rows, _ROWS), spark.createDataFrame(errors, "physical_line int, message string")


def classify(rows: DataFrame, links: DataFrame, dry_run: bool = True) -> DataFrame:
    """rows with outcome (added, skipped, conflict) and existing, the code that a conflicting one is linked to.

    A dry run holds each row against the links in force alone. Applied, a row also meets what the rows before it
    have set: the first usable row of a code decides, and later rows with another working code are conflicts.
    """
    usable = (F.col("icode") != "") & (F.col("working_code") != "")
    link = links.groupBy("icode").agg(F.max(F.struct("id", "working_code"))["working_code"].alias("linked"))
    out = rows.join(link, "icode", "left")
    if not dry_run:
        before = Window.partitionBy("icode").orderBy("line")
        first = F.first(F.when(usable, F.col("working_code")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("linked", F.coalesce("linked", first))
    clash = F.col("linked").isNotNull() & (F.col("linked") != F.col("working_code"))
    outcome = F.when(~usable, "skipped").when(clash, "conflict").otherwise("added")
    return out.withColumn("outcome", outcome).select(*rows.columns, "outcome", F.when(usable & clash, F.col("linked")).alias("existing"))


def counters(classified: DataFrame, errors: DataFrame) -> DataFrame:
    """(total, added, skipped, conflicts, errors), one row."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o if o != "conflict" else "conflicts")
    return classified.agg(F.count("*").alias("total"), n("added"), n("skipped"), n("conflict")).crossJoin(F.broadcast(errors.agg(F.count("*").alias("errors"))))  # one row with one row


def as_changes(classified: DataFrame) -> DataFrame:
    """Added rows as changes for links.upsert: approved, without a score; later rows replace earlier names."""
    return classified.where("outcome = 'added'").select(F.col("line").alias("seq"), "icode", "working_code", "dispensed_name", "purchased_name", F.lit("approved").alias("match_method"), F.lit(None).cast("double").alias("match_score"))
