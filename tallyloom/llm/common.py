"""What the operators of this subpackage share: scratch tables, batch scans, defaults for odd inputs."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.textscan import chunks

#: Bytes of text that a Python worker holds as objects at once; a longer text is held alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
#: Per thread, the scratch tables made within each only_last.
_WITHIN = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster, an error."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        base = _OWN_DIRS[app]
    path = f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    _MADE.setdefault(app, []).append(path)
    for made in getattr(_WITHIN, "made", []):
        made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the scratch tables that this application has made so far and returns their number.

    Results are read from them lazily: call it when all results at hand have been written.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the scratch tables that this thread makes within, only the last one stays: all others were steps to it."""
    stack = _WITHIN.made = getattr(_WITHIN, "made", [])
    stack.append(made := [])
    try:
        yield
    finally:
        stack.pop()
    _delete(spark, made[:-1])
    if kept := _MADE.get(spark.sparkContext.applicationId):
        kept[:] = [p for p in kept if p not in set(made[:-1])]


def own(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex}"


#: With it a query deletes its shuffle files as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back. Lost executors cannot lose it. What df shuffled is deleted once it is written."""
    spark = df.sparkSession
    path, before = scratch_dir(spark), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:  # a query keeps the setting that it was made under, so df is made anew
        df.select("*").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # no one looks for a marker here
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving unused memory back to the system when its task ends: workers that wait for the next one hold little."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass

    return task


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(lean(run), schema) for any column names: run sees its input's columns by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(lean(run), schema)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the columns of these names in any letter case: an operator's own columns replace the input's."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def scan_texts(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    columns_of: Callable[[pa.Array], Sequence[pa.Array | list]],
    *,
    keep: Sequence[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Appends columns computed from the text column in one pass without a shuffle.

    columns_of gets the texts of a slice of at most slice_bytes (or a single longer text) and returns one array
    for each field. keep: input columns of the result (default: all). Input columns with a field's name give way.
    """
    names = [f.name for f in fields]
    source = drop_columns(df, [n for n in names if n.lower() != text.lower()])
    kept = [c for c in (source.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    if keep is not None:
        source = source.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text}`"]))
    at = source.columns.index(text)
    out = T.StructType([source.schema[c] for c in kept] + list(fields))
    places = [source.columns.index(c) for c in kept]
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _ in chunks(batch.column(at), slice_bytes):
                part = batch.slice(begin, end - begin)
                made = columns_of(part.column(at))
                arrays = [part.column(i) for i in places]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n).type) for x, n in zip(made, names, strict=True)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return in_arrow(source, run, out)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
