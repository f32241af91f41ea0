"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash. Pass 2 reads each bucket into
one task, orders it by the hash, permutes it by a seeded Fisher-Yates shuffle and writes it to the shared folder
with each record's place in the bucket. Places joined end to end are one permutation of all records; dealing it
out in turn gives shards whose counts differ by one at most (law `rows`), with gapless slots.

Where each bucket begins is a prefix sum over buckets in two levels, on executors: the driver sees no row of it. The
table of beginnings has 16 bytes for each bucket (42 as a hash table), a two-millionth of the records; it meets them in a join, with the
advice to broadcast it up to BROADCAST_BUCKETS buckets.

The hash takes the id, the text and the record's ordinal in its input split, so neither a repeated id nor a text
that a third of all rows share fills a bucket. A split's records keep their ordinals when a task runs again.

Defined cases: null ids and texts are records like any other (a null text has no bytes and the checksum of the
empty text); repeated rows each get their own slot; a record longer than a bucket makes its bucket larger; an empty
table gives no records; other columns go along, and those named like a result column, in any letter case, give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import drop_columns, in_arrow, materialize, own

SHARDS = 16
BUCKET_BYTES = 32 << 20
SEED = 20_240_601
#: Buckets whose beginnings may be broadcast (166 MB as a hash table, as measured), and how many of them one task sums up.
BROADCAST_BUCKETS, LEVEL = 4_000_000, 4096
_OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Records that go back to the JVM at once.
_BATCH = 4096


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n places: from the last place down, each is swapped with a uniform one at or before it."""
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    pick = (draws * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = pick[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket: str = "bucket", place: str = "place") -> DataFrame:
    """The records with their bucket and their place in it, as written to the shared folder: a table of one file set a bucket."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)) + F.count("*") * 64).first()[0]
    buckets = max(1, -(-int(total) // bucket_bytes))
    source = drop_columns(docs, [bucket, place])
    by = own("key")
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.monotonically_increasing_id())
    keyed = source.withColumn(by, key).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), by), F.lit(buckets)).cast("int"))
    schema = T.StructType([*source.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField(place, T.LongType())])
    arrow, n = to_arrow_schema(schema), len(source.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        del held
        key_of, at = rows.column(n).to_numpy(), rows.column(n + 1).to_numpy()
        order = np.lexsort((key_of, at))
        at = at[order]
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[cut[1:], len(at)]
        taken, places = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
            taken[a:b] = order[a:b][fisher_yates(b - a, seed + int(at[a]))]
            places[a:b] = np.arange(b - a)
        for a in range(0, len(at), _BATCH):
            part = rows.take(pa.array(taken[a : a + _BATCH]))
            part = pa.Table.from_arrays([*part.columns[:n], part.column(n + 1), pa.array(places[a : a + _BATCH])], names=arrow.names)
            yield from part.cast(arrow).combine_chunks().to_batches()

    return materialize(in_arrow(_by_bucket(keyed, buckets, bucket), run, schema))


def _by_bucket(keyed: DataFrame, buckets: int, bucket: str) -> DataFrame:
    if hasattr(keyed, "repartitionById"):
        return keyed.repartitionById(buckets, F.col(bucket))
    return keyed.repartition(buckets, bucket)


def beginnings(done: DataFrame, bucket: str, first: str, level: int = LEVEL) -> tuple[DataFrame, int]:
    """((bucket, number of records in the buckets before it), number of buckets): sums over buckets within blocks of `level`, and over blocks."""
    counts = materialize(done.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col(bucket) / level)).coalesce(1))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("block"))).drop("n")  # one row for `level` buckets
    within = counts.withColumn("within", before(Window.partitionBy("block").orderBy(bucket)))
    out = materialize(within.join(blocks, "block").select(F.col(bucket), (F.col("base") + F.col("within")).alias(first)).coalesce(1))
    return out, counts.count()


def shard(docs: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with size, text_crc32, law (`rows`), shard, slot and grown_shard (null: the law gives no promise on growth)."""
    source, bucket, at, first = drop_columns(docs, _OWN), own("bucket"), own("place"), own("first")
    done = shuffle(source, doc_id=doc_id, text=text, seed=seed, bucket_bytes=bucket_bytes, bucket=bucket, place=at)
    table, n = beginnings(done, bucket, first)
    done = done.join(table.hint("broadcast") if n <= BROADCAST_BUCKETS else table, bucket)
    place = F.col(first) + F.col(at)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return done.select(
        *[F.col(f"`{c}`") for c in source.columns],
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        ((place - F.pmod(place, F.lit(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, *, files: int = SHARDS) -> None:
    """Writes each shard as one Parquet folder shard=N, rows in slot order. A shard is split over tasks by slot, and those stay in order by file name."""
    sharded.repartitionByRange(files * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
