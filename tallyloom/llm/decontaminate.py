"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned over word windows.

A window is `width` consecutive words of a benchmark item (A-Z lower-cased); an item of fewer words, but not
none, is one window by itself. A document word inside any occurrence of a window is hit.

The n-gram set is broadcast in slices of at most `slice_words` benchmark words, and no two slices are held at once:
the driver reads the benchmark a slice at a time, and a slice is one narrow pass over the documents. With one slice
that is all. With more, the documents are written once with a row number, each pass leaves the thin rows that it
hits in the shared folder before the next slice is read, and rows meet their hits in one join at the end. Document
windows are hashed 64 bits wide in vectorised form, looked up in a bitmap and a sorted array, and every hit is
verified on its words.

Defined cases: null and empty texts have no words and no hits; null or empty items have no windows; a null
item_id never shows in `item_ids` but its windows hit; repeated items count once by id, repeated documents each
for themselves; an item longer than a slice is cut into pieces that overlap by a window; an empty benchmark leaves
every document clean; an empty table gives an empty result; a very long text is scanned whole. Extra columns stay:
those named like a result column, in any letter case, give way in find_contamination and report, and stay as they
are in remove_documents and remove_spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import SLICE_BYTES, drop_columns, in_arrow, materialize, own
from tallyloom.llm.textscan import Words, ascii_lower_table, chunks, ranges, rolled, scan, separator_table, window_starts

WIDTH = 10
#: Benchmark words in one broadcast slice, reckoned at two bytes a word: its table takes some 40 MB in a worker.
SLICE_WORDS = 2_000_000
#: Characters between words: all of ASCII but digits and letters.
SEPARATORS = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LOWER = ascii_lower_table()
SPANS_TYPE, IDS_TYPE = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
_STATE = ("n_words", "hit_spans", "item_ids")
_BITS = 22
Items = list[tuple[str | None, str]]


@dataclass
class Chunk:
    """Texts of some rows: their words lower-cased, and their bytes as they are."""

    begin: int
    end: int
    words: Words
    hashes: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def scan_words(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Chunk]:
    for begin, end, data, offsets in chunks(column, most):
        words = scan(LOWER[data], offsets, SEPARATORS)
        yield Chunk(begin, end, words, words.hashes(), data, offsets)


def _spelled(words: Words, at: int, width: int) -> bytes:
    return b" ".join([words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(at, at + width)])


@dataclass
class _Width:
    """Windows of one width: sorted distinct hashes, the words of each (text[start:end]) and its items (a run of `items`)."""

    keys: np.ndarray
    bitmap: np.ndarray
    start: np.ndarray
    end: np.ndarray
    run: np.ndarray
    items: np.ndarray
    other: dict[int, dict[bytes, list[int]]]  # further windows of the same hash


class Grams:
    """The n-gram set of one slice, in flat arrays: some 30 bytes for each window beside the words."""

    def __init__(self, items: Items, width: int):
        self.ids = [key for key, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, size = [], 0
        for c in scan_words(pa.array([t for _, t in items], pa.string())):
            words = c.words
            length = words.ends - words.starts
            place = np.cumsum(length + 1) - (length + 1)  # where each word stands once they are joined by single spaces
            joined = np.full(int((length + 1).sum()), 32, np.uint8)
            joined[ranges(place, length)] = words.data[ranges(words.starts, length)]
            for w in {width, *np.unique(words.per_doc[(words.per_doc > 0) & (words.per_doc < width)]).tolist()}:
                count = words.per_doc if w == width else np.where(words.per_doc == w, w, 0)
                first, doc = window_starts(count, words.first, w)
                if len(first):
                    last = first + w - 1
                    found.setdefault(w, []).append((rolled(c.hashes, w)[first], place[first] + size, place[last] + length[last] + size, doc + c.begin))
            texts.append(joined.tobytes())
            size += len(joined)
        self.text = b"".join(texts)
        self.widths = {w: self._width([np.concatenate(x) for x in zip(*parts, strict=True)]) for w, parts in sorted(found.items())}

    def _width(self, parts: list[np.ndarray]) -> _Width:
        code, start, end, item = parts
        order = np.lexsort((item, code))
        code, start, end, item = code[order], start[order], end[order], item[order]
        new = np.r_[True, code[1:] != code[:-1]]
        run = np.flatnonzero(new)
        owner = np.cumsum(new) - 1
        other: dict[int, dict[bytes, list[int]]] = {}
        same = np.ones(len(code), dtype=bool)
        for i in np.flatnonzero(~new).tolist():
            k = int(owner[i])
            f = run[k]
            if self.text[start[i] : end[i]] != self.text[start[f] : end[f]]:
                same[i] = False
                other.setdefault(k, {}).setdefault(self.text[start[i] : end[i]], []).append(int(item[i]))
        bitmap = np.zeros(1 << _BITS, dtype=bool)
        keys = code[run]
        bitmap[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return _Width(keys, bitmap, start[run], end[run], np.r_[np.searchsorted(np.flatnonzero(same), run), same.sum()], item[same].astype(np.int32), other)

    def hits(self, c: Chunk) -> tuple[np.ndarray, dict[int, set]]:
        """(whether each word is hit, items of each text that has hits)."""
        words, covered, items = c.words, np.zeros(len(c.hashes), dtype=bool), {}
        for w, g in self.widths.items():
            codes = rolled(c.hashes, w)
            if not len(codes):
                continue
            maybe = np.flatnonzero(g.bitmap[(codes >> np.uint64(64 - _BITS)).astype(np.int64)])
            place = np.searchsorted(g.keys, codes[maybe])
            place[place == len(g.keys)] = 0
            good = (g.keys[place] == codes[maybe]) & (words.doc[maybe] == words.doc[np.minimum(maybe + w - 1, len(words.doc) - 1)])
            runs: dict[int, set] = {}
            for at, k in zip(maybe[good].tolist(), place[good].tolist(), strict=True):
                spelled = _spelled(words, at, w)
                doc = int(words.doc[at])
                if spelled == self.text[g.start[k] : g.end[k]]:
                    runs.setdefault(doc, set()).add(k)
                elif spelled in g.other.get(k, ()):
                    items.setdefault(doc, set()).update(g.other[k][spelled])
                else:
                    continue
                covered[at : at + w] = True
            for doc, ks in runs.items():
                for k in ks:
                    items.setdefault(doc, set()).update(g.items[g.run[k] : g.run[k + 1]].tolist())
        return covered, items


_BUILT: list = []


def _grams(items: Items, width: int) -> Grams:
    """The slice's set, built once in a worker process for each broadcast (tasks of a process see the same list)."""
    if not (_BUILT and _BUILT[0] is items and _BUILT[1] == width):
        _BUILT.clear()  # the last slice's goes first
        _BUILT.extend((items, width, Grams(items, width)))
    return _BUILT[2]


def _pieces(text: str, words: int, width: int) -> Iterator[str]:
    """A long item in parts of so many words (reckoned as above) whose windows together are the item's."""
    if len(text) // 2 < words:
        yield text
        return
    raw = text.encode()
    found = next(scan_words(pa.array([raw], pa.binary()), 1 << 62)).words
    n, step = len(found.starts), max(words, width)
    for a in range(0, max(n - width + 1, 1), step):
        b = min(n, a + step + width - 1)
        if b > a:
            yield raw[found.starts[a] : found.ends[b - 1]].decode()


def _slices(benchmark: DataFrame, item_id: str, text: str, slice_words: int, width: int) -> Iterator[Items]:
    """The benchmark a slice at a time; the driver holds one slice and what Spark hands over."""
    part, n = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator()
    for key, body in rows:
        for piece in _pieces(body, slice_words, width):
            size = len(piece) // 2 + 1  # words at most
            if part and n + size > slice_words:
                yield part
                part, n = [], 0
            part.append((key, piece))
            n += size
    if part:
        yield part


def _edges(hit: np.ndarray) -> list[list[int]]:
    """[first, end) of each run of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2).tolist()


def _pass(docs: DataFrame, text: str, items: Items, width: int, names: tuple[str, str, str], only_hits: bool = False) -> DataFrame:
    """One slice over the documents: appends its hits. only_hits: rows without any are left out."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS_TYPE), T.StructField(names[2], IDS_TYPE)])
    shared, columns = docs.sparkSession.sparkContext.broadcast(items), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(shared.value, width)
        for batch in batches:
            for c in scan_words(batch.column(at)):
                covered, found = grams.hits(c)
                spans: list[list] = [[]] * (c.end - c.begin)
                ids: list[list] = [[]] * (c.end - c.begin)
                for doc, own_items in found.items():
                    first = int(c.words.first[doc])
                    spans[doc] = _edges(covered[first : first + int(c.words.per_doc[doc])])
                    ids[doc] = sorted({grams.ids[i] for i in own_items} - {None})
                part = batch.slice(c.begin, c.end - c.begin)
                made = [pa.array(c.words.per_doc, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*part.columns, *made], names=columns)
                if only_hits:
                    keep = np.zeros(c.end - c.begin, dtype=bool)
                    keep[list(found)] = True
                    out = out.filter(pa.array(keep))
                yield out

    return in_arrow(docs, run, schema)


def _merged(hits: DataFrame, row: str, names: tuple[str, str, str]) -> DataFrame:
    """A row for each document from those of all slices: spans united, ids sorted and distinct."""
    columns = [row, *names]
    one = hits.groupBy(row).agg(F.max(names[0]).alias(names[0]), F.flatten(F.collect_list(names[1])).alias(names[1]), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias(names[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            united = []
            for spans in batch.column(2).to_pylist():
                out: list[list[int]] = []
                for a, b in sorted(spans):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                united.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(united, batch.schema.field(2).type), batch.column(3)], names=columns)

    return in_arrow(one, run, one.schema)


def _found(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], text: str, item_id: str, item_text: str, width: int, slice_words: int) -> DataFrame:
    """docs with three more columns of these names."""
    slices = _slices(benchmark, item_id, item_text, slice_words, width)
    first = next(slices, [])
    second = next(slices, None)
    if second is None:
        return _pass(docs, text, first, width, names)
    row = own("row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    thin = rows.select(row, text)
    hits = materialize(_pass(thin, text, first, width, names).drop(text))  # the first slice tells of every row
    while second is not None:
        hits = hits.unionByName(materialize(_pass(thin, text, second, width, names, only_hits=True).drop(text)))
        second = next(slices, None)
    return rows.join(_merged(hits, row, names), row).select(*[F.col(f"`{c}`") for c in docs.columns], *names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (array of [first word, end word), disjoint, ascending) and item_ids (sorted)."""
    return _found(drop_columns(docs, _STATE), benchmark, _STATE, text, item_id, item_text, width, slice_words)


def report(found: DataFrame) -> DataFrame:
    """The digest of find_contamination: n_words, n_hit, n_items, items_sha256, contaminated beside the other columns."""
    made = {"hit_spans", "item_ids", "n_hit", "n_items", "items_sha256", "contaminated"}
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c.lower() not in made],
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents without any hit, with all of their own columns as they were."""
    names = (own("n_words"), own("hit_spans"), own("item_ids"))
    found = _found(docs, benchmark, names, text, item_id, item_text, width, slice_words)
    return found.where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents with every hit span cut from the text, from its first word's first to its last word's last character.

    A null text stays null; other texts lose nothing but the spans; all other columns stay as they were.
    """
    names = (own("n_words"), own("hit_spans"), own("item_ids"))
    found = _found(docs, benchmark, names, text, item_id, item_text, width, slice_words)
    columns_of = found.columns
    at, spans_at = columns_of.index(text), columns_of.index(names[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in scan_words(batch.column(at)):
                part = batch.slice(c.begin, c.end - c.begin)
                texts = part.column(at).to_pylist()
                for doc, spans in enumerate(part.column(spans_at).to_pylist()):
                    if spans:
                        base, done, pieces = int(c.words.first[doc]), int(c.offsets[doc]), []
                        for a, b in spans:
                            pieces.append(c.data[done : c.words.starts[base + a]].tobytes())
                            done = int(c.words.ends[base + b - 1])
                        pieces.append(c.data[done : c.offsets[doc + 1]].tobytes())
                        texts[doc] = b"".join(pieces).decode()
                columns = [*part.columns]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=columns_of)

    return in_arrow(found, run, found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
