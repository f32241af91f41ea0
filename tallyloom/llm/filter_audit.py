"""Filter interaction audit: what each of five filters removes after others, in every order of the five.

Each document gets a mask of the filters that it fails: A too few words, B too few distinct words, C too many capitals,
D symbols, E a text that a smaller id has too. E comes from a sort: documents are range-partitioned by text
fingerprint and id and sorted by fingerprint, full text and id, so copies stand in a row, and a row with a copy before
it compares with the first of the row. As ids take part in the ranges, a text that a third of all documents share is
spread over many tasks; the ranges are found from fingerprints and ids alone, so no text goes to the driver. A range may
begin within a fingerprint: only a partition's first and last fingerprint can have copies elsewhere, and of these only
rows that hold the smallest id there are still open. They are written with a digest of their text, and the smallest
id of each digest over all partitions settles them: a few rows a partition.

The thin rows (id, part, mask) then meet the labels and become counts by part and mask, at most 32 a part, that add
up; all orders, steps and Shapley values are sums over these.

Defined cases: a null text is the empty text, which has no words and fails A alone (and E after a smaller id); words are
runs without ASCII white space, upper and lower case apart; a null id is smaller than none and has no smaller one; rows
of one id are judged one by one and do not make each other duplicates; a document counts as labelled when any row of
labels says so, nulls say nothing; a null part is the empty string; very long texts are taken whole; no documents give
no rows; columns of any other name play no part.
"""

from __future__ import annotations

import hashlib
import json
import math
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import in_arrow, materialize

FILTERS = "ABCDE"
WHITE = " \t\n\x0b\f\r"
#: A fails below so many words; B below so many distinct ones in a hundred; C above so many capitals in a hundred characters.
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Rows that a task holds back until it knows whether their mark goes on in another one.
HELD = 1000


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_mask(text: Column) -> Column:
    """The bits of A to D of a text."""
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    fails = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0)).cast("int")


def failures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails, as bits in the order of FILTERS."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    return _with_copies(rows.withColumn("mark", F.xxhash64("text")), text_mask(F.col("text")))


def _with_copies(rows: DataFrame, mask: Column) -> DataFrame:
    """(doc_id, part, mask) of rows (mark, text, doc_id, part): mask with bit E. mark: any number that depends on the text alone.

    The mask is computed behind the sort: the pass that looks for the ranges reads texts only for their marks.
    """
    place = [F.col("mark"), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(place[0], "text", place[1])
    dealt = dealt.select("mark", "text", "doc_id", "part", mask.alias("mask"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = materialize(in_arrow(dealt, _against_predecessors, f"doc_id {kind}, part string, mask int, mark long, digest string"))
    undecided = F.col("digest").isNotNull()
    first = found.where(undecided).groupBy("mark", "digest").agg(F.min("doc_id").alias("first"))
    copy = F.when(F.col("first") < F.col("doc_id"), _bit("E")).otherwise(0)
    settled = found.where(undecided).join(first, ["mark", "digest"]).select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
    return found.where(~undecided).select("doc_id", "part", "mask").unionByName(settled)


def _against_predecessors(batches):
    """One sorted partition: bit E for rows after a smaller id of the same text. Rows with the smallest id of their run that may have copies elsewhere get their mark and a digest."""
    opening = mark = least = text = None
    held: list[tuple] = []  # rows of the mark at hand that have no smaller id in this partition

    def let_go(undecided: bool) -> list[tuple]:
        out = [(*r[:3], mark, hashlib.sha256(r[3][r[4]].as_py().encode()).hexdigest()) if undecided else (*r[:3], None, None) for r in held]
        held.clear()
        return out

    def batch_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "part", "mask", "mark", "digest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        marks, ids, parts, masks = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        texts, kind, out = batch.column(1), batch.column(2).type, []
        same = [text is not None and texts[0].as_py() == text, *pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()]
        for i, doc in enumerate(ids):
            if marks[i] != mark:
                out += let_go(mark == opening)  # a mark between the first and the last has no rows elsewhere
                mark = marks[i]
                opening = mark if opening is None else opening
            if not same[i]:
                least = doc
            if doc is None:
                out.append((None, parts[i], masks[i], None, None))
            elif least < doc:
                out.append((doc, parts[i], masks[i] | _bit("E"), None, None))
            else:
                held.append((doc, parts[i], masks[i], texts, i))
                if len(held) >= HELD:
                    out += let_go(True)
        text = texts[len(texts) - 1].as_py()
        if out:
            yield batch_of(out, kind)
    if held:
        yield batch_of(let_go(True), kind)


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just these filters, and those labelled good and toxic. They add up over tables."""
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(said, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _steps() -> list[dict]:
    """Each step of each order: its filter's bit, and the bits of the filters before it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    return [{"filter_order": o, "step": i + 1, "bit": _bit(o[i]), "before": sum(map(_bit, o[:i]))} for o in orders for i in range(len(o))]


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step from counters: what the step keeps and removes, and what its filter is worth."""
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.select("*", F.inline(steps))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    total = lambda name, condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).alias(name)
    orders = math.factorial(len(FILTERS))
    return rows.groupBy("part", "filter_order", "step").agg(
        total("kept", ~fails & ~earlier), total("removed", fails & ~earlier), total("redundant", fails & earlier), total("unique_fails", mask == bit),
        total("good_lost", fails & ~earlier, "good"), total("toxic_lost", fails & ~earlier, "toxic"),
        # of the filters that a document fails each is the first in as many orders
        F.sum(F.when(fails, F.col("n") * (orders / F.bit_count(mask)).cast("long")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return interactions(counters(failures(docs, doc_id=doc_id, text=text, part=part), labels))
