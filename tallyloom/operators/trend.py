"""Trends over the twelve months of a year: windows over a full month grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_grid(months: DataFrame, keys: list[str], amounts: list[str], tasks: int | None = None) -> DataFrame:
    """months with a row for every fiscal month of each key, 0.0 where there was none. One shuffle, by the keys; tasks: into so many parts, which windows by the keys keep."""
    if tasks is not None:
        months = months.repartition(tasks, *keys)
    cells = months.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.struct("month_idx", a))).alias(a) for a in amounts])
    grid = cells.withColumn("month_idx", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return grid.select(*keys, "month_idx", *[F.coalesce(F.try_element_at(F.col(a), F.col("month_idx")), F.lit(0.0)).alias(a) for a in amounts])


def _year(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("month_idx")


def moving_average(amount: str, keys: list[str], width: int = 3) -> Column:
    """Trailing mean of the last `width` months, of fewer at the start."""
    return F.avg(amount).over(_year(keys).rowsBetween(1 - width, 0))


def running_total(amount: str, keys: list[str]) -> Column:
    return F.sum(amount).over(_year(keys).rowsBetween(Window.unboundedPreceding, 0))


def month_share(amount: str, keys: list[str]) -> Column:
    """Percent of the year; of 1 where the year's total is below that."""
    return F.round(F.col(amount) / F.greatest(F.sum(amount).over(Window.partitionBy(*keys)), F.lit(1.0)) * 100.0, 1)
