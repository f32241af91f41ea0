"""Logical inputs of the analytics, and where they come from: Parquet tables, a database, or any DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISPENSE = T.StructType([T.StructField("icode", T.StringType()), T.StructField("vstdate", T.DateType()), T.StructField("qty", T.DoubleType())])
ITEMS = T.StructType([T.StructField("icode", T.StringType()), T.StructField("name", T.StringType())])
HEADERS = T.StructType([T.StructField("invoice_no", T.StringType()), T.StructField("receive_date", T.IntegerType())])
LINES = T.StructType([T.StructField("invoice_no", T.StringType()), T.StructField("working_code", T.StringType()), T.StructField("qty_order", T.DoubleType()), T.StructField("value", T.DoubleType())])
CATALOG = T.StructType([T.StructField("working_code", T.StringType()), T.StructField("drug_name", T.StringType())])
LINKS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("icode", T.StringType()), T.StructField("working_code", T.StringType()),
    T.StructField("dispensed_name", T.StringType()), T.StructField("purchased_name", T.StringType()),
    T.StructField("match_method", T.StringType()), T.StructField("match_score", T.DoubleType()),
])
EXCLUSIONS = T.StructType([T.StructField("icode", T.StringType()), T.StructField("reason", T.StringType())])


@dataclass(frozen=True)
class Inputs:
    """dispense and items: what was given out. headers, lines and catalog: what was bought. links and exclusions: how codes meet.

    Facts that are laid out by fiscal year (sources.facts) have its column `fy`, and their years (fy) are known beforehand.
    """

    dispense: DataFrame
    items: DataFrame
    headers: DataFrame
    lines: DataFrame
    catalog: DataFrame
    links: DataFrame
    exclusions: DataFrame
    dispense_years: DataFrame | None = None
    purchase_years: DataFrame | None = None


def _part_name() -> str:
    return "concat(p_name, ' ', cast(p_size as string), ' mg')"


def dispensed_lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.where("l_linestatus = 'F'").selectExpr("cast(l_partkey as string) as icode", "l_shipdate as vstdate", "l_quantity as qty")


def bought_lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.where("l_linestatus = 'O'").selectExpr("l_orderkey as invoice_no", "cast(l_partkey as string) as working_code", "l_quantity as qty_order", "l_extendedprice as value")


def from_star(spark: SparkSession, sf_dir: str) -> Inputs:
    """The inputs as found in order tables: finished lines are given out, open ones bought; parts are the items.

    Catalog names have their words turned round and every tenth part is missing; four of five parts are linked, and
    every twenty-fifth is excluded. Only needed columns are named, so scans read no more.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, lineitem = read("part"), read("lineitem")
    key = "cast(p_partkey as string)"
    turned = "array_join(reverse(split(p_name, ' ')), ' ')"
    link = part.where("p_partkey % 5 <> 0").selectExpr(
        "p_partkey as id", f"{key} as icode", f"{key} as working_code", f"{_part_name()} as dispensed_name",
        f"concat({turned}, ' ', cast(p_size as string), ' mg') as purchased_name",
        "case p_partkey % 3 when 0 then 'auto' when 1 then 'manual' else 'approved' end as match_method",
        "cast(case when p_partkey % 3 = 0 then 1.0 end as double) as match_score",
    )
    return Inputs(
        dispense=dispensed_lines(lineitem),
        items=part.selectExpr(f"{key} as icode", f"{_part_name()} as name"),
        headers=read("orders").selectExpr("o_orderkey as invoice_no", "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as receive_date", "o_orderdate as receive_day"),
        lines=bought_lines(lineitem),
        catalog=part.where("p_partkey % 10 <> 0").selectExpr(f"{key} as working_code", f"concat({turned}, ' ', cast(p_size as string), ' mg') as drug_name"),
        links=link,
        exclusions=part.where("p_partkey % 25 = 0").selectExpr(f"{key} as icode", "'not stocked' as reason"),
    )


def one_name(catalog: DataFrame, code: str, name: str) -> DataFrame:
    """One row a code, with the least of its names: several names never multiply facts."""
    return catalog.groupBy(code).agg(F.min(name).alias(name))


#: Records of facts from which a task of their sums is made.
TASK_ROWS = 250_000


def tasks_for(*tables: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for records that meet by a key: as many as the records ask for. Spark joins small partitions by their compressed bytes, so a task's memory would grow with the input."""
    return max(1, -(-sum(t.count() for t in tables) // rows))


def dealt(rows: DataFrame, tasks: int = 3) -> DataFrame:
    """rows over all cores, some tasks a core: names compress to files of a few MB, which Spark would read in one or two tasks."""
    return rows.repartition(tasks * max(2, rows.sparkSession.sparkContext.defaultParallelism))
