"""The inputs from the two databases by JDBC. Ranges of the date column are read in parallel; filters and the join of lines to headers go to the server."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import fiscal
from tallyloom.sources import links_store
from tallyloom.sources.tables import Inputs


@dataclass(frozen=True)
class Database:
    """kind: mysql or sqlserver. The password is a connection property, so nothing needs escaping in the address."""

    kind: str
    host: str
    port: int
    name: str
    user: str
    password: str = field(repr=False)
    instance: str = ""
    encrypt: bool = False
    partitions: int = 12
    probe: str = "SELECT 1 AS one"

    def url(self) -> str:
        if self.kind == "mysql":
            return f"jdbc:mysql://{self.host}:{self.port}/{self.name}"
        if self.kind == "sqlserver":
            place = f"{self.host};instanceName={self.instance}" if self.instance else f"{self.host}:{self.port}"
            return f"jdbc:sqlserver://{place};databaseName={self.name};encrypt={str(self.encrypt).lower()}"
        raise ValueError(f"unknown database kind: {self.kind}")

    def options(self) -> dict[str, str]:
        return {"url": self.url(), "user": self.user, "password": self.password, "fetchsize": "10000"}

    def ping(self, spark: SparkSession) -> bool:
        """Whether the probe's 1 comes back; the driver's error is raised where there is no connection."""
        return spark.read.format("jdbc").options(**self.options(), query=self.probe).load().collect()[0][0] == 1

    def table(self, spark: SparkSession, name: str, split: str | None = None, low: str | int | None = None, high: str | int | None = None) -> DataFrame:
        """A table or a query in brackets with a name; with split, that many ranges of this column are read side by side."""
        read = spark.read.format("jdbc").options(**self.options(), dbtable=name)
        if split:
            read = read.options(partitionColumn=split, lowerBound=str(low), upperBound=str(high), numPartitions=str(self.partitions))
        return read.load()

    def parts(self, spark: SparkSession, name: str, conditions: list[str]) -> DataFrame:
        """A table or a query in brackets with a name, a partition for each of the conditions, which the server applies."""
        own = self.options()
        return spark.read.jdbc(own.pop("url"), name, predicates=conditions, properties=own)


def _months(column: str, first_year: int, last_year: int) -> list[str]:
    """A condition for each month of some fiscal years on YYYYMMDD integers: even ranges of these would mostly be empty."""
    starts = [(y - (m >= 10)) * 100 + m for y in range(first_year, last_year + 1) for m in (10, 11, 12, *range(1, 10))]
    return [f"{column} BETWEEN {s}01 AND {s}31" for s in starts]


def dispense(spark: SparkSession, db: Database, table: str, first_year: int, last_year: int) -> DataFrame:
    """Dispense facts of some fiscal years: one partition or more for each range of dates."""
    low, high = fiscal.date_window(first_year)[0], fiscal.date_window(last_year)[1]
    rows = db.table(spark, table, "vstdate", low.isoformat(), high.isoformat())
    return rows.where((F.col("vstdate") >= low) & (F.col("vstdate") < high)).selectExpr("cast(icode as string) as icode", "vstdate", "cast(qty as double) as qty")


def items(spark: SparkSession, db: Database, table: str) -> DataFrame:
    """Dispensed items; a code is text, whatever it looks like."""
    return db.table(spark, table).selectExpr("cast(icode as string) as icode", "cast(name as string) as name")


def catalog(spark: SparkSession, db: Database, table: str) -> DataFrame:
    """The purchase catalog; a code may have several names."""
    return db.table(spark, table).selectExpr("cast(WORKING_CODE as string) as working_code", "cast(DRUG_NAME as string) as drug_name")


def headers(spark: SparkSession, db: Database, table: str, first_year: int, last_year: int) -> DataFrame:
    """Invoices received in some fiscal years, a partition a month."""
    rows = db.parts(spark, table, _months("RECEIVE_DATE", first_year, last_year))
    return rows.selectExpr("cast(INVOICE_NO as string) as invoice_no", "cast(RECEIVE_DATE as int) as receive_date")


def lines(spark: SparkSession, db: Database, table: str, headers: str, first_year: int, last_year: int) -> DataFrame:
    """Lines of invoices received in some fiscal years: the server joins them to their headers, and a month is a partition."""
    joined = f"(SELECT c.INVOICE_NO, c.WORKING_CODE, c.QTY_ORDER, c.VALUE, h.RECEIVE_DATE FROM {table} c JOIN {headers} h ON h.INVOICE_NO = c.INVOICE_NO) bought"
    rows = db.parts(spark, joined, _months("RECEIVE_DATE", first_year, last_year))
    return rows.selectExpr("cast(INVOICE_NO as string) as invoice_no", "cast(WORKING_CODE as string) as working_code", "cast(QTY_ORDER as double) as qty_order", "cast(VALUE as double) as value")


@dataclass(frozen=True)
class Names:
    """Names of the tables in the two databases."""

    dispense: str
    items: str
    headers: str
    lines: str
    catalog: str


def from_databases(spark: SparkSession, dispensing: Database, purchasing: Database, names: Names, first_year: int, last_year: int, store: str) -> Inputs:
    """The inputs of some fiscal years: facts and dimensions from the two databases, links and exclusions from the store at a path."""
    links, exclusions = links_store.open_store(spark, store)
    return Inputs(
        dispense=dispense(spark, dispensing, names.dispense, first_year, last_year),
        items=items(spark, dispensing, names.items),
        headers=headers(spark, purchasing, names.headers, first_year, last_year),
        lines=lines(spark, purchasing, names.lines, names.headers, first_year, last_year),
        catalog=catalog(spark, purchasing, names.catalog),
        links=links,
        exclusions=exclusions,
    )
