"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model holds a whitespace marker after another character, segmentation never crosses the start of
a marked word: a text's ids are those of its marked words in order, and so is its decoded text. A slice of texts is cut
into marked words at once, brought to its distinct ones with an index a word, the words that the table does not hold
yet are segmented by the library, each once, and ids are joined back by position in array operations. The table holds
words that came more than once, belongs to a worker process and starts anew at `table_size` words, so memory is bounded;
only speed depends on it. `encode_once` is the same with one table over all documents, kept as a DataFrame and joined by word.

Decoding knows nothing of the text: it lays out the bytes that each of the assembled ids stands for, by position, and
reads them as UTF-8. Ids that have no bytes of their own (unknown and control pieces) and bytes that are no UTF-8 send
that text's ids to the library's decoder, whole.

Texts that hold a marker as a character, and models whose pieces do cross markers or that normalise text, go to the
library whole.

Defined cases: a null text is the empty text, with no ids, and decodes to the empty text; nothing is cut, a very long
text or word is taken whole; repeated rows give equal rows; an empty table gives an empty result; other columns stay,
those named like a result column, in any letter case, give way.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import drop_columns, in_arrow, materialize, own, scan_texts
from tallyloom.llm.textscan import chunks, ranges

MARK = "▁"
#: Distinct words that a process keeps, and the text that it cuts at once, in bytes.
TABLE_SIZE, SLICE = 300_000, 6 << 20
#: A word longer than this is segmented without entering the table.
LONGEST_KEPT = 64


def marked_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(marked words of all texts, their number in each text). A word stands without its first marker, which the library adds.

    A word ends at the first of a run of spaces; that space is the marker of the next word, further ones are part of it.
    Spaces at the start of a text follow the marker that the library puts there, so they are part of the first word.
    """
    parts, counts = [], []
    for _, _, data, offsets in chunks(column, 1 << 62):
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        later = starts[(starts > 0)]
        cut[later[space[later]]] = False  # a text's first space cuts nothing, whatever stands before the text
        if len(starts):
            cut[starts[0]] = False
        # a space after a text's leading ones was compared with the space before it, within the text
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(cut)))
        at = np.sort(np.concatenate((starts, np.flatnonzero(cut) + 1)))
        kept = data[~cut]
        bounds = np.concatenate((at - before[at], [len(kept)])).astype(np.int64)
        parts.append(pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))))
        counts.append(before[offsets[1:]] - before[offsets[:-1]] + (offsets[1:] > offsets[:-1]))
    if not parts:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    return parts[0], counts[0]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@dataclass
class Encoded:
    """ids and spelled-out forms of a column of texts: `of[d]:of[d + 1]` is text d's part of each."""

    ids: np.ndarray
    ids_of: np.ndarray
    decoded: list[bytes]
    spelled: list[bytes]


class Encoder:
    """Encodes and decodes with one model."""

    def __init__(self, model: str, table_size: int = TABLE_SIZE):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        self.table_size = table_size
        self.table: dict[str, bytes] = {}  # ids of words that came more than once, four bytes each
        self.decimals = pa.array([f"{i}," for i in range(n)], pa.large_binary())
        spelled = [self._bytes(i) for i in range(n)]
        self.plain = np.array([s is not None for s in spelled], bool)  # ids that stand for bytes
        self.marked = np.array([self.library.id_to_piece(i).startswith(MARK) for i in range(n)], bool)
        self.bytes = np.frombuffer(b"".join(s or b"" for s in spelled), np.uint8)
        self.byte_size = np.fromiter((len(s or b"") for s in spelled), np.int64, n)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.joined = not any(MARK in self.library.id_to_piece(i).lstrip(MARK) for i in range(n))
        probes = ["a", "a b", " a", "a ", "  a  b ", "ﬁ ÅΩÅ \t\n　x", "a\nb", ""]
        if self.joined:
            found = self.run(pa.array(probes), True, True)
            for i, t in enumerate(probes):
                want = self.library.encode(t)
                self.joined &= found.ids[found.ids_of[i] : found.ids_of[i + 1]].tolist() == want and found.decoded[i].decode() == self.library.decode(want)

    def _bytes(self, i: int) -> bytes | None:
        """What an id stands for within a text; None for unknown, control and unused pieces."""
        if self.library.is_unknown(i) or self.library.is_control(i) or self.library.is_unused(i):
            return None
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(MARK, " ").encode()

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of each word, four bytes each."""
        ids = [i or [self.library.piece_to_id(MARK)] for i in self.library.encode(words, num_threads=1)] if words else []
        return [array("i", i).tobytes() for i in ids]

    def entries(self, words: list[str], often: list[bool]) -> list[bytes]:
        """Ids of some distinct words; those that come often enter the table."""
        get = self.table.get
        out = [get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.table) + len(new) > self.table_size:
            self.table.clear()
        for i, x in zip(new, self.segment([words[i] for i in new]), strict=True):
            out[i] = x
            if often[i] and len(words[i]) <= LONGEST_KEPT:
                self.table[words[i]] = x
        return out

    def run(self, column: pa.Array, decode: bool = False, spell: bool = False) -> Encoded:
        """Encodes a column; decodes the ids and spells them in decimals if asked for."""
        column = column.fill_null("")
        if not self.joined:
            return self._whole(column, decode, spell)
        marked = pc.match_substring(column, MARK)
        if pc.any(marked).as_py():
            return self._both(column, marked, decode, spell)
        words, count = marked_words(column)
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        entries = self.entries(distinct, (np.bincount(index, minlength=len(distinct)) > 1).tolist())
        length = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        size = length[index]
        ids = np.frombuffer(b"".join(entries), np.int32)[ranges((np.cumsum(length) - length)[index], size)]
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))  # a text's words
        ids_of = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[bounds]
        return Encoded(ids, ids_of, self.decoded(ids, ids_of) if decode else [], self._spelled(ids, ids_of) if spell else [])

    def decoded(self, ids: np.ndarray, ids_of: np.ndarray) -> list[bytes]:
        """The text of each ids[ids_of[d]:ids_of[d + 1]], from the ids alone; as the library decodes them."""
        size, full = self.byte_size[ids], np.flatnonzero(ids_of[1:] > ids_of[:-1])
        raw = self.bytes[ranges(self.byte_start[ids], size)].tobytes()
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[ids_of]
        first = at[:-1].copy()
        first[full] += self.marked[ids[ids_of[full]]]  # the marker that the library puts before a text
        plain = np.concatenate((np.zeros(1, np.int64), np.cumsum(~self.plain[ids])))[ids_of]
        whole = (plain[1:] == plain[:-1]).tolist()
        out = [raw[a:b] for a, b in zip(first.tolist(), at[1:].tolist(), strict=True)]
        for d, x in enumerate(out):
            if not whole[d] or not (x.isascii() or _is_utf8(x)):
                out[d] = self.library.decode(ids[ids_of[d] : ids_of[d + 1]].tolist()).encode()
        return out

    def _spelled(self, ids: np.ndarray, ids_of: np.ndarray) -> list[bytes]:
        every = self.decimals.take(pa.array(ids))
        _, off, data = every.buffers()
        at = np.frombuffer(off, np.int64, count=len(every) + 1)[ids_of].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[a : b - 1]) if b > a else b"" for a, b in zip(at, at[1:], strict=False)]

    def _whole(self, column: pa.Array, decode: bool, spell: bool) -> Encoded:
        ids = [self.library.encode(t) for t in column.to_pylist()]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        ids_of = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(i) for i in ids]))).astype(np.int64)
        return Encoded(flat, ids_of, [self.library.decode(i).encode() if i else b"" for i in ids] if decode else [], [",".join(map(str, i)).encode() for i in ids] if spell else [])

    def _both(self, column: pa.Array, marked: pa.Array, decode: bool, spell: bool) -> Encoded:
        mask = marked.to_numpy(zero_copy_only=False)
        a, b = self.run(column.filter(pc.invert(marked)), decode, spell), self._whole(column.filter(marked), decode, spell)
        back = np.empty(len(mask), np.int64)
        back[np.concatenate((np.flatnonzero(~mask), np.flatnonzero(mask)))] = np.arange(len(mask))
        size = np.concatenate((np.diff(a.ids_of), np.diff(b.ids_of)))
        starts = np.concatenate((a.ids_of[:-1], b.ids_of[:-1] + len(a.ids)))
        order = lambda x, y: [(x + y)[i] for i in back.tolist()] if x or y else []
        return Encoded(np.concatenate((a.ids, b.ids))[ranges(starts[back], size[back])], np.concatenate((np.zeros(1, np.int64), np.cumsum(size[back]))), order(a.decoded, b.decoded), order(a.spelled, b.spelled))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def encoder(model: str, table_size: int = TABLE_SIZE) -> Encoder:
    return Encoder(model, table_size)


def _lists(found: Encoded) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(found.ids_of, pa.int32()), pa.array(found.ids, pa.int32()))


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "token_ids", table_size: int = TABLE_SIZE) -> DataFrame:
    """docs with an array<int> of token ids. model: a path that every executor can open."""
    return scan_texts(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda c: [_lists(encoder(model, table_size).run(c))], slice_bytes=SLICE)


def encode_once(docs: DataFrame, model: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """encode by one table of all distinct marked words of docs: each is segmented once, and ids are joined back by word and ordered by position.

    It moves every word of every text by its spelling and its ids by the text: many times the input. For models whose
    pieces do not cross markers.
    """
    row, body = own("row"), F.coalesce(F.col(text), F.lit(""))
    rows = materialize(drop_columns(docs, [ids]).withColumn(row, F.monotonically_increasing_id()))

    def cut(batches):
        for batch in batches:
            words, count = marked_words(batch.column(1))
            at = np.cumsum(count) - count
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(ranges(np.zeros(len(count), np.int64), count)) if len(at) else pa.array([], pa.int64()), words.cast(pa.string())], names=["row", "place", "word"])

    def segment(batches):
        one = encoder(model)
        if not one.joined:
            raise ValueError("this model's pieces cross markers")
        for batch in batches:
            words = batch.column(0).to_pylist()
            made = [np.frombuffer(x, np.int32) for x in one.segment(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["word", "ids"])

    words = in_arrow(rows.select(row, F.translate(body, MARK, " ")), cut, "row long, place long, word string")
    table = in_arrow(words.select("word").distinct(), segment, "word string, ids array<int>")
    back = words.join(table, "word").groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias(ids))
    return rows.join(back.withColumnRenamed("row", row), row, "left").select(*[F.col(f"`{c}`") for c in rows.columns if c != row], F.coalesce(ids, F.array().cast("array<int>")).alias(ids))


def decode(docs: DataFrame, model: str, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give the empty text."""
    source = drop_columns(docs, [text])
    at, names = source.columns.index(ids), [*source.columns, text]
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        one = encoder(model)
        for batch in batches:
            made = pa.array([one.decode(x) if x else "" for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=names)

    return in_arrow(source, run, schema)


def round_trip(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256, in one pass."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def columns_of(column: pa.Array) -> list[pa.Array | list]:
        found, hash_of = encoder(model, table_size).run(column, decode=True, spell=True), hashlib.sha256
        return [pa.array(np.diff(found.ids_of)), [hash_of(x).hexdigest() for x in found.spelled], [hash_of(x).hexdigest() for x in found.decoded]]

    return scan_texts(docs, text, fields, columns_of, keep=keep, slice_bytes=SLICE)


def reencode(docs: DataFrame, model: str, *, text: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """docs as a pipeline's last stage keeps them: with token_ids, n_tokens and whether decoding gave the text back."""
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())]

    def columns_of(column: pa.Array) -> list[pa.Array | list]:
        found = encoder(model, table_size).run(column, decode=True)
        raw = column.fill_null("").cast(pa.binary()).to_pylist()
        return [_lists(found), pa.array(np.diff(found.ids_of)), [a == b for a, b in zip(found.decoded, raw, strict=True)]]

    return scan_texts(docs, text, fields, columns_of, slice_bytes=SLICE)
