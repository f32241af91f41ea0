"""A persisted index for searches in the two catalogs: postings of runs of three characters.

A row of the catalog stands under each distinct run of three characters of its code and its name, lower case. Any row that
a term of three characters or more finds has all of the term's runs, so the rows under the rarest one are enough: a
search reads the postings of one run, and applies the exact condition of `operators.search` to them. Postings lie in
BLOCKS folders by a hash of the run, and sorted by run within, so the folder is chosen by its partition value and the
row groups by the run's bounds. A run that most rows share is dealt over files by code and name, so no task writes it
alone. How many rows each run has is a small table beside them, laid out alike.

Terms without a run (shorter ones, or wildcard terms without three plain characters in a row) scan the catalog, which
is kept here too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN, BLOCKS = 3, 256


def _block(run: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(blocks)).cast("int")


def _runs(text: Column) -> Column:
    """The runs of RUN characters of a text, empty where it is shorter."""
    places = F.sequence(F.lit(1), F.char_length(text) - RUN + 1)
    return F.when(F.char_length(text) >= RUN, F.transform(places, lambda i: F.substring(text, i, RUN))).otherwise(F.array().cast("array<string>"))


def write(rows: DataFrame, path: str, code: str, name: str, blocks: int = BLOCKS) -> None:
    """Writes the index of rows (code, name) under a path, over what is there. blocks: its folders; readers give the same number."""
    kept = rows.select(code, name)
    kept.repartitionByRange(code, name).write.mode("overwrite").parquet(f"{path}/rows")
    lower = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    runs = F.array_distinct(F.concat(_runs(lower(code)), _runs(lower(name))))
    posted = kept.select(code, name, F.explode(runs).alias("run")).withColumn("block", _block(F.col("run"), blocks))
    place = ["block", "run", code, name]
    posted.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("block").mode("overwrite").parquet(f"{path}/postings")
    counts = posted.groupBy("block", "run").agg(F.count("*").alias("rows"))
    counts.repartitionByRange("block", "run").sortWithinPartitions("block", "run").write.partitionBy("block").mode("overwrite").parquet(f"{path}/counts")


@dataclass(frozen=True)
class Postings:
    """The index at a path."""

    spark: SparkSession
    path: str
    blocks: int = BLOCKS

    def _table(self, name: str) -> DataFrame:
        if name == "counts":
            return self.spark.read.schema("run string, rows long, block int").parquet(f"{self.path}/counts")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        # an index of no rows has no folder that its columns could be read from
        return rows if name == "rows" else self.spark.read.schema(rows.schema.add("run", "string").add("block", "integer")).parquet(f"{self.path}/postings")

    def _under(self, name: str, runs: list[str]) -> DataFrame:
        """The rows of a table under some runs; their folders are named, so that others are not opened."""
        # Spark works out the blocks of literals while it plans
        return self._table(name).where(F.col("block").isin(*[_block(F.lit(r), self.blocks) for r in runs]) & F.col("run").isin(*runs)).drop("block")

    def rarest(self, term: str, wildcards: bool = False) -> tuple[str, int] | None:
        """The run of a term that the fewest rows have, with their number; None for a term without a run. wildcards: % and _ stand for other characters."""
        plain = re.split("[%_]", term) if wildcards else [term]
        low = [p.lower() for p in plain]
        runs = list(dict.fromkeys(p[i : i + RUN] for p in low for i in range(len(p) - RUN + 1)))
        if not runs:
            return None
        found = {r.run: r.rows for r in self._under("counts", runs).collect()}  # a row for each run of the term
        return min(((r, found.get(r, 0)) for r in runs), key=lambda x: (x[1], x[0]))

    def rows(self, term: str, wildcards: bool = False) -> DataFrame:
        """The rows (code, name) among which all are that a term finds."""
        run = self.rarest(term, wildcards)
        return self._table("rows") if run is None else self._under("postings", [run[0]]).drop("run")
