"""CSV files of links, read in parallel: what `operators.bulk.parse` gives for the same text, without the driver.

Files are cut at line ends into Spark's splits, so a quoted field may go over lines, and over splits. Three passes:

1. Each split is scanned twice at once, as if it began outside of quotes and within them. What comes out is one row a
   split: its lines, whether it ends within quotes, and where the record that is open there began.
2. For each file these rows are put in order: each split's state at its beginning follows from those before it, and
   so do the numbers of its lines. That is a row a split, never the text.
3. Each split is parsed from its true state. Records within one line are parsed where they stand. Lines of a record that
   goes over several are brought together by the line on which it begins, and parsed there.

Ordinals of rows are a second sum of the same shape: rows in a split, then the splits of all files in the order of their
paths. Lines end in \\n, \\r\\n or \\r; physical lines count from 1 in each file. A quote that is never closed makes one field
of the rest of its file, as it does in pasted text.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import bulk

_SPLIT = ["file", "block"]
_PIECES = "file string, block long, begins int, physical_line int, text string, kind string, icode string, working_code string, dispensed_name string, purchased_name string"
_FIELDS = ["icode", "working_code", "dispensed_name", "purchased_name"]


def open_after(line: str, inside: bool) -> bool:
    """Whether quotes are open after a physical line, if they were before it. A quote opens a field only where it is its first character."""
    i, n = 0, len(line)
    while i < n:
        if inside:
            i = line.find('"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] == '"':  # two are one character of the field
                i += 2
                continue
            inside, i = False, i + 1
            i = line.find(",", i)  # whatever stands behind the closing quote belongs to the field
        else:
            while line[i : i + 1] == " ":
                i += 1
            if line[i : i + 1] == '"':
                inside, i = True, i + 1
                continue
            i = line.find(",", i)
        if i < 0:
            return False
        i += 1
    return inside


def physical_lines(chunk: str) -> list[str]:
    """The lines of what stood between two \\n, with their ends."""
    return list(io.StringIO(chunk + "\n", newline="")) or ["\n"]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, at, text): lines in the order of their splits. A split's rows follow one another."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _runs(batches):
    """(file, block, texts) of consecutive rows of one split."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        texts, begin = batch.column("text").to_pylist(), 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[begin], blocks[begin]):
                yield files[begin], blocks[begin], texts[begin:i]
                begin = i


def _scan(batches):
    """A row a split: lines, and for both states at its beginning whether quotes are open at its end, and the line where the open record began (-1: before the split)."""
    found: dict[tuple[str, int], list] = {}
    for file, block, texts in _runs(batches):
        one = found.setdefault((file, block), [0, [False, True], [-1, -1]])
        for text in texts:
            for line in physical_lines(text):
                if '"' in line:
                    after = [open_after(line, s) for s in one[1]]
                    one[2] = [one[0] if a and not s else o for a, s, o in zip(after, one[1], one[2], strict=True)]
                    one[1] = after
                one[0] += 1
    keys = list(found)
    columns = [[k[0] for k in keys], [k[1] for k in keys], [found[k][0] for k in keys], *[[found[k][j][s] for k in keys] for j in (1, 2) for s in (0, 1)]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_SPLIT, "n", "end0", "end1", "open0", "open1"])


def _places(splits):
    """One file's splits in order: the state at each one's beginning, the lines before it, the line on which the open record began."""
    inside, before, begins, out = False, 0, 0, []
    for r in splits.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, before, begins))
        end, at = (r.end1, r.open1) if inside else (r.end0, r.open0)
        if end and at >= 0:
            begins = before + at + 1
        inside, before = bool(end), before + r.n
    return type(splits)(out, columns=[*_SPLIT, "inside", "before", "begins"])


def _parse(batches):
    """Records within a line, parsed, and the lines of longer ones."""
    state: tuple = (None, None)
    inside, line_no, begins = False, 0, 0
    for batch in batches:
        columns = batch.to_pydict()
        out = []
        for file, block, text, was_inside, before, began in zip(*[columns[c] for c in (*_SPLIT, "text", "inside", "before", "begins")], strict=True):
            if (file, block) != state:
                state, inside, line_no, begins = (file, block), was_inside, before, began
            for line in physical_lines(text):
                line_no += 1
                opened = open_after(line, inside) if '"' in line else inside
                if not inside and not opened:
                    out += _record(file, block, line_no, line)
                else:
                    begins = begins if inside else line_no
                    out.append((file, block, begins, line_no, line, "piece", None, None, None, None))
                inside = opened
        yield _batch(out)


def _record(file: str, block: int, at: int, text: str) -> list[tuple]:
    """A record's row or error, nothing for a blank one or a header."""
    rows, errors = bulk.parse(text)
    return [(file, block, at, at, None, "row", *r[2:]) for r in rows] + [(file, block, at, at, m, "error", None, None, None, None) for m in (f"line {at}:{e[1].split(':', 1)[1]}" for e in errors)]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*_SPLIT, "begins", "physical_line", "text", "kind", *_FIELDS])


def _joined(batches):
    for batch in batches:
        out = []
        for file, block, begins, text in zip(*[batch.column(c).to_pylist() for c in (*_SPLIT, "begins", "text")], strict=True):
            out += _record(file, block, begins, text)
        yield _batch(out)


def read(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files as bulk.read gives them for a text, with the file. Ordinals go through all files by their paths."""
    lines = _lines(spark, paths)
    splits = lines.mapInArrow(_scan, "file string, block long, n int, end0 boolean, end1 boolean, open0 int, open1 int")
    places = splits.groupBy("file").applyInPandas(_places, "file string, block long, inside boolean, before int, begins int")
    # Spark broadcasts the places if they are small, else it sorts: either way a split's lines stay together and in order
    placed = lines.join(places, _SPLIT).sortWithinPartitions(*_SPLIT, "at")
    found = placed.mapInArrow(_parse, _PIECES)
    long = found.where("kind = 'piece'").groupBy("file", "begins").agg(F.min("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("physical_line", "text"))), lambda x: x["text"]), "").alias("text"))
    every = found.where("kind <> 'piece'").unionByName(long.mapInArrow(_joined, _PIECES))
    rows = every.where("kind = 'row'")
    counts = rows.groupBy(*_SPLIT).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    counts = counts.select(*_SPLIT, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*_SPLIT).orderBy("physical_line")
    rows = rows.withColumn("n", F.row_number().over(within)).join(counts, _SPLIT)
    errors = every.where("kind = 'error'").select("file", "physical_line", F.col("text").alias("message"))
    return rows.select("file", (F.col("earlier") + F.col("n")).cast("int").alias("line"), "physical_line", *_FIELDS), errors
