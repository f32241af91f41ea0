"""Substring dedup by grouping suffixes over words, in tasks split by prefix. No suffix tree is built.

The suffixes of all documents, each cut at `depth` words, are split by variable-length prefixes: a suffix goes by
its first word, unless the suffixes that begin so are more than fit in memory, then by its first two words, four
words, and so on to `depth`. Prefixes are counted over all documents in SLOTS slots of a hash, and the plan made of
the counts has the same size for every corpus; a slot that is still too full at the last prefix is split by a second
code of the suffix. A task sorts the codes of its suffixes and groups equal ones. A group with suffixes of two documents
is a repeat; words of its occurrences after the document of the smallest id are removed. Column `repeats` holds runs
of removed words: neighbouring repeats of different sources join, so they need not be maximal repeats.

A suffix travels as a 64-bit code of its words with its document and position, both packed, not as the words
themselves: the README has the figures of what words, or a tree built of them, would move. The words behind a code are
not compared. Slots and splits come from a second code, independent of the first, so different words are taken for
equal only if their first codes agree and their second ones lead to one task: with n suffixes in tasks of m, n * m /
2^65 pairs are expected to, which is linear in n (one code alone: n^2 / 2^65). For 100 TB, some 2.6e13 suffixes, that
is half a window, where one code alone would give 2e7. What a scan task compares by itself goes by the first code alone,
among some 1e6 suffixes and 2.6e5 known codes at a time, which adds about one window. A scan keeps the smallest
document of each code that it has met in two documents, and sends such a suffix only if it may be that document's:
the others are known repeats already. So a passage that a third of all documents share costs a few entries a scan task,
not one a document.

Repeats go back to the documents by buckets of (id, text); a bucket takes its repeats in first, and its documents pass
through one block at a time, so an id that many rows share fills no memory.

Defined cases: null and empty texts, and texts under `depth` words, lose nothing; a null id is never smaller than
another, and its row loses nothing; rows of one id are one document, which repeats nothing of its own, and rows
that share an id but not the text are told apart by 20 bits of a checksum of it; repeated rows give equal rows; of
ties the smallest id keeps its words; a very long text is scanned whole; an empty table gives an empty result; other
columns stay, and those named like a result column, in any letter case, give way.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
import pyarrow.ipc  # noqa: F401  (used as pa.ipc)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import SLICE_BYTES, drop_columns, in_arrow
from tallyloom.llm.textscan import WHITE, Words, chunks, mix, ranges, rolled, scan, separator_table

DEPTH = 13
#: Suffixes that one task holds.
GROUP_SUFFIXES = 750_000
SEPARATORS = separator_table(WHITE)
_U = np.uint64
#: Text whose suffixes are packed and compared as one batch, in bytes.
SCATTER_BYTES = 4 << 20
#: Text that one task takes back, in bytes before packing.
BUCKET_BYTES = 48 << 20
#: Slots of each prefix length that suffixes are counted in, and codes that a scan task knows as repeated: fixed sizes.
SLOTS, KNOWN_CODES = 1 << 16, 1 << 18
#: Repeats that a bucket holds before it drops those that came twice.
HELD_HITS = 4_000_000
SUFFIXES, HITS, ROWS = 0, 1, 2
_BLOCKS = "kind int, to long, block binary"
_BLOCK_NAMES = ["kind", "to", "block"]
#: Bits of a position; the rest of its word holds a tag of the text.
_POS_BITS, _TAG_BITS = 40, 20


def prefix_depths(depth: int) -> list[int]:
    out = [1]
    while out[-1] * 2 < depth:
        out.append(out[-1] * 2)
    return [d for d in out if d < depth] + [depth]


def _suffixes(words: Words, hashes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, text) of every suffix of at least depth words."""
    count = np.maximum(words.per_doc - depth + 1, 0)
    return ranges(words.first, count), np.repeat(np.arange(len(count)), count)


def _tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A few bits of each whole text."""
    raw = memoryview(np.ascontiguousarray(data))
    at = offsets.tolist()
    return np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)), np.int64, len(at) - 1) & ((1 << _TAG_BITS) - 1)


def _scan(column: pa.Array, ids: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, their hashes, ids, tags) of the chunks of a column; rows without an id have no words."""
    for begin, end, data, offsets in chunks(column, most):
        words = scan(data, offsets, SEPARATORS)
        known = ids.slice(begin, end - begin).is_valid().to_numpy(zero_copy_only=False)
        words.per_doc = np.where(known, words.per_doc, 0)
        yield words, words.hashes(), ids.slice(begin, end - begin).fill_null(0).to_numpy(zero_copy_only=False), _tags(data, offsets)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the words. Sums over them say nothing about sums over the first ones."""
    return mix(hashes, 33)


def _slots(second: np.ndarray, width: int, at: np.ndarray, slots: int) -> np.ndarray:
    return (rolled(second, width, seed=width)[at] % _U(slots)).astype(np.int64)


def _tasks_of(hashes: np.ndarray, at: np.ndarray, depths: list[int], task: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """The task of the suffix at each word, by a plan of plan_groups."""
    second, to = _second(hashes), np.full(len(at), -1, np.int64)
    for i, w in enumerate(depths):
        open_ = np.flatnonzero(to < 0)
        if not len(open_):
            break
        slot = _slots(second, w, at[open_], task.shape[1])
        to[open_] = task[i][slot]
        wide = np.flatnonzero(ways[i][slot] > 1)
        if len(wide):
            to[open_[wide]] += (rolled(second, w, seed=33)[at[open_[wide]]] % ways[i][slot[wide]].astype(np.uint64)).astype(np.int64)
    return to


def count_prefixes(docs: DataFrame, depth: int, slots: int = SLOTS) -> np.ndarray:
    """Suffixes in each slot of each prefix depth, over all documents; the sums are made in two steps on executors."""
    depths = prefix_depths(depth)

    def count(batches):
        total = np.zeros((len(depths), slots), np.int64)
        for batch in batches:
            for words, hashes, _, _ in _scan(batch.column(1), batch.column(0)):
                at, _ = _suffixes(words, hashes, depth)
                if len(at):
                    second = _second(hashes)
                    for i, w in enumerate(depths):
                        total[i] += np.bincount(_slots(second, w, at, slots), minlength=slots)
        yield pa.RecordBatch.from_arrays([pa.array([int(total.sum()) % 32], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                one = np.frombuffer(zstandard.decompress(blob), np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    shape = "at int, counts binary"
    partial = in_arrow(in_arrow(docs, count, shape).repartition(32, "at"), add, shape)
    total = np.zeros(len(depths) * slots, np.int64)
    for row in partial.toLocalIterator():  # 32 rows at most, of a fixed size
        total += np.frombuffer(zstandard.decompress(bytes(row["counts"])), np.int64)
    return total.reshape(len(depths), slots)


def plan_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first task of each slot of each depth, or -1 where its suffixes go by a longer prefix; tasks that it is split over; number of tasks)."""
    depths, slots = counts.shape
    task, ways, tasks = np.full((depths, slots), -1, np.int64), np.ones((depths, slots), np.int64), 0
    for i in range(depths):
        n, last = counts[i], i == depths - 1
        # a slot's suffixes reach depth i if the shorter prefixes' slots were too large; counting all of them is a safe bound
        small = np.flatnonzero(n <= most)
        before = np.cumsum(n[small]) - n[small]
        task[i, small] = tasks + before // most
        tasks += int(before[-1] // most) + 1 if len(small) else 0
        large = np.flatnonzero(n > most)
        if not len(large):
            break
        if last:
            ways[i, large] = -(-n[large] // most)
            task[i, large] = tasks + np.cumsum(ways[i, large]) - ways[i, large]
            tasks += int(ways[i, large].sum())
    return task, ways, max(tasks, 1)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of the differences: small steps pack to little."""
    step = np.diff(values, prepend=np.int64(0)).astype(np.int64)
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view(np.int64).ravel())


def pack(codes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> bytes:
    """codes may be empty: then only ids and places come back."""
    head = np.array([len(codes), len(ids)], np.int64).tobytes()
    return head + codes.tobytes() + zstandard.compress(_planes(ids) + _planes(places), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = np.frombuffer(blob, np.int64, count=2).tolist()
    rest = zstandard.decompress(blob[16 + 8 * m :])
    return np.frombuffer(blob, np.uint64, count=m, offset=16), _unplanes(rest[: 8 * n], n), _unplanes(rest[8 * n :], n)


def bucket_of(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(ids.view(np.uint64), 31) ^ tags.astype(np.uint64), 32) % _U(buckets)).astype(np.int64)


def _cut(to: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if not len(to):
        return []
    begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return list(zip(to[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(to)].tolist(), strict=True))


def _hit_blocks(ids: np.ndarray, places: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Repeats packed by the bucket of their document."""
    to = bucket_of(ids, places >> _POS_BITS, buckets)
    order = np.lexsort((places, ids, to))
    to, ids, places = to[order], ids[order], places[order]
    return [(t, pack(np.zeros(0, np.uint64), ids[a:b], places[a:b])) for t, a, b in _cut(to)]


def _rows(kind: int, blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(blocks), pa.int32()), pa.array([t for t, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())], names=_BLOCK_NAMES)


class _Known:
    """The smallest document of codes that a scan task has met in two documents; at most KNOWN_CODES of them, which matters for speed alone."""

    def __init__(self):
        self.codes, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def first(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each suffix may stand in the smallest document of its code, by what is known; learns from them."""
        order = np.argsort(code, kind="stable")
        c, o = code[order], own[order]
        new = np.r_[True, c[1:] != c[:-1]]
        run = np.flatnonzero(new)
        least, most, codes = np.minimum.reduceat(o, run), np.maximum.reduceat(o, run), c[run]
        if len(self.codes):
            place = np.searchsorted(self.codes, codes)
            place[place == len(self.codes)] = 0
            met = self.codes[place] == codes
            least[met] = np.minimum(least[met], self.least[place[met]])
            self.least[place[met]] = least[met]
        else:
            met = np.zeros(len(codes), dtype=bool)
        out = np.empty(len(code), dtype=bool)
        out[order] = o == least[np.cumsum(new) - 1]
        more = np.flatnonzero(~met & (least < most))[: KNOWN_CODES - len(self.codes)]
        if len(more):
            merged = np.concatenate((self.codes, codes[more]))
            order = np.argsort(merged)
            self.codes, self.least = merged[order], np.concatenate((self.least, least[more]))[order]
        return out


def _scatter(docs: DataFrame, depth: int, task: np.ndarray, ways: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of suffixes for their group's task, and of repeats known within a scan task for their document's bucket."""
    shared = docs.sparkSession.sparkContext.broadcast((task.astype(np.int32), ways.astype(np.int32)))
    depths = prefix_depths(depth)

    def run(batches):
        plan, split = shared.value
        known = _Known()
        for batch in batches:
            for words, hashes, ids, tags in _scan(batch.column(1), batch.column(0), SCATTER_BYTES):
                at, doc = _suffixes(words, hashes, depth)
                if not len(at):
                    continue
                code = rolled(hashes, depth)[at]
                place = (at - words.first[doc]) | (tags[doc] << _POS_BITS)
                own = ids[doc]
                first = known.first(code, own)
                if not first.all():
                    yield _rows(HITS, _hit_blocks(own[~first], place[~first], buckets))
                at, code, own, place = at[first], code[first], own[first], place[first]
                to = _tasks_of(hashes, at, depths, plan, split)
                order = np.lexsort((place, own, to))
                to, code, own, place = to[order], code[order], own[order], place[order]
                yield _rows(SUFFIXES, [(t, pack(code[a:b], own[a:b], place[a:b])) for t, a, b in _cut(to)])

    return in_arrow(docs, run, _BLOCKS)


def _grouped(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of a task by code and returns the places that repeat a smaller document's; known ones pass."""
    got = []
    for batch in batches:
        kind, to, blocks = batch.columns
        known = pa.compute.equal(kind, HITS)
        got += [unpack(x) for x in blocks.filter(pa.compute.invert(known)).to_pylist()]
        if pa.compute.any(known).as_py():
            yield pa.RecordBatch.from_arrays([kind.filter(known), to.filter(known), blocks.filter(known)], names=_BLOCK_NAMES)
    if not got:
        return
    code, ids, places = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.argsort(code, kind="stable")
    code, ids, places = code[order], ids[order], places[order]
    new = np.r_[True, code[1:] != code[:-1]]
    least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = ids > least
    if hit.any():
        yield _rows(HITS, _hit_blocks(ids[hit], places[hit], buckets))


def _row_blocks(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """The documents themselves, all columns, packed by bucket. Rows without an id have no repeats and go anywhere."""
    at, text_at = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for n, batch in enumerate(batches):
            ids = batch.column(at).cast(pa.int64())
            tags = np.concatenate([_tags(data, offsets) for _, _, data, offsets in chunks(batch.column(text_at))] or [np.zeros(0, np.int64)])
            to = np.where(ids.is_valid().to_numpy(zero_copy_only=False), bucket_of(ids.fill_null(0).to_numpy(zero_copy_only=False), tags, buckets), (n + np.arange(len(ids))) % buckets)
            order = np.argsort(to, kind="stable")
            blocks = []
            for t, a, b in _cut(to[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(order[a:b])))
                blocks.append((t, sink.getvalue().to_pybytes()))
            yield _rows(ROWS, blocks)

    return in_arrow(docs, run, _BLOCKS)


def _dealt(blocks: DataFrame, parts: int, by_task: bool) -> DataFrame:
    """Each task's or bucket's blocks in a partition of its own; repeats on their way go to any task."""
    to = F.when(F.col("kind") == SUFFIXES, F.col("to")).otherwise(F.pmod(F.xxhash64("to", F.length("block")), F.lit(parts))) if by_task else F.col("to")
    if hasattr(blocks, "repartitionById"):
        return blocks.repartitionById(parts, to.cast("int"))
    return blocks.repartition(parts, to)


def _judged(docs: DataFrame, doc_id: str, text: str, depth: int, group_suffixes: int, fields: list[T.StructField], made) -> DataFrame:
    """docs with columns that made(words, which are removed, texts) computes from each chunk of texts."""
    source = drop_columns(docs, [f.name for f in fields if f.name.lower() != text.lower()])
    thin = source.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = thin.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    task, ways, tasks = plan_groups(count_prefixes(thin, depth), group_suffixes)
    buckets = max(1, -(-size // BUCKET_BYTES))
    found = in_arrow(_dealt(_scatter(thin, depth, task, ways, buckets), tasks, True), lambda b: _grouped(b, buckets), _BLOCKS)
    # a bucket's repeats come before its documents
    both = _dealt(found.union(_row_blocks(source, doc_id, text, buckets)), buckets, False).sortWithinPartitions("kind")
    kept = [c for c in source.columns if c.lower() not in {f.name.lower() for f in fields}]
    out = T.StructType([source.schema[c] for c in kept] + fields)
    names, id_at, text_at, places_of = out.names, source.columns.index(doc_id), source.columns.index(text), [source.columns.index(c) for c in kept]

    def run(batches):
        hits, held, index = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, None
        for batch in batches:
            for kind, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == HITS:
                    hits.append(unpack(block)[1:])
                    held += len(hits[-1][0])
                    if held > HELD_HITS:
                        hits, held = [_distinct(hits)], 0
                    continue
                if index is None:
                    index, hits = _distinct(hits), []
                for rows in pa.ipc.open_stream(block):
                    for begin, end, data, offsets in chunks(rows.column(text_at)):
                        part = rows.slice(begin, end - begin)
                        words = scan(data, offsets, SEPARATORS)
                        gone = _covered(words, part.column(id_at).cast(pa.int64()), _tags(data, offsets), *index, depth)
                        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places_of), *made(words, gone, part.column(text_at))], names=names)

    return in_arrow(both, run, out)


def _distinct(hits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Repeats sorted by document and place, each once."""
    ids, places = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
    return ids[new], places[new]


def _covered(words: Words, own: pa.Array, tags: np.ndarray, ids: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Whether each word of a chunk is covered by a repeat. ids: sorted, each with the place of one."""
    step = np.zeros(len(words.starts) + 1, np.int64)
    if len(ids) and len(words.starts):
        key, known = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(ids, key, side="left"), np.searchsorted(ids, key, side="right")
        count = np.where(known, high - low, 0)
        doc, mine = np.repeat(np.arange(len(key)), count), places[ranges(low, count)]
        start = mine & ((1 << _POS_BITS) - 1)
        fits = (mine >> _POS_BITS == tags[doc]) & (start + depth <= words.per_doc[doc])
        at = words.first[doc[fits]] + start[fits]
        np.add.at(step, at, 1)
        np.add.at(step, at + depth, -1)
    return np.cumsum(step[:-1]) > 0


def _kept_texts(words: Words, gone: np.ndarray) -> Iterator[bytes]:
    """Kept words of each text, joined by one space."""
    raw = words.data.tobytes()
    for first, n in zip(words.first.tolist(), words.per_doc.tolist(), strict=True):
        mine = ~gone[first : first + n]
        if mine.all():
            yield b" ".join(raw[words.starts[first] : words.ends[first + n - 1]].split()) if n else b""
        else:
            at = np.flatnonzero(mine) + first
            yield b" ".join([raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words joined by one space) and repeats: maximal runs of removed words."""
    run = T.ArrayType(T.ArrayType(T.LongType()))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("repeats", run)]

    def made(words: Words, gone: np.ndarray, column: pa.Array) -> list[pa.Array]:
        lost = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
        runs = []
        for first, n in zip(words.first.tolist(), words.per_doc.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[first : first + n].view(np.int8), [0]))))
            runs.append(edge.reshape(-1, 2).tolist())
        return [
            pa.array(words.per_doc, pa.int64()), pa.array(lost[words.first + words.per_doc] - lost[words.first], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in _kept_texts(words, gone)], pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64()))),
        ]

    return _judged(docs, doc_id, text, depth, group_suffixes, fields, made)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs with repeated words cut: a text that loses some becomes its kept words joined by one space; others, null too, stay as they are."""

    def made(words: Words, gone: np.ndarray, column: pa.Array) -> list[pa.Array]:
        lost = np.concatenate((np.zeros(1, np.int64), np.cumsum(gone)))
        any_ = lost[words.first + words.per_doc] > lost[words.first]
        return [pa.array([k.decode() if x else t for k, x, t in zip(_kept_texts(words, gone), any_.tolist(), column.to_pylist(), strict=True)], pa.string())]

    return _judged(docs, doc_id, text, depth, group_suffixes, [T.StructField(text, T.StringType())], made).select(*[F.col(f"`{c}`") for c in docs.columns])
