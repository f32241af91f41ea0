"""Byte-level BPE encoding and decoding by merge rounds over many words at once.

A slice of texts is cut into words by the pattern of the model's pre-tokenizer. The distinct words that the process
has not met yet are laid into one flat array of byte symbols. A round looks up the pairs of neighbours by binary
search over the model's sorted pair keys, finds each word's lowest rank with a segmented minimum, merges all
occurrences of that pair (from the left, without overlap) and lets go of words that have no pair left; it needs as
many rounds as the slowest word has ranks. Words above LONG bytes would need many rounds over much data: they take their
merges one by one from a heap of (rank, place), the same merges in the same order. Ids are then joined back by position.

Decoding looks up the bytes of each id, lays them out by position and reads them as UTF-8, with a replacement
character for what is none.

The cutting pattern depends on Unicode's categories. Texts with characters that this Python does not know as assigned
are cut by the tokenizers library, whose table may be another one. Added tokens are found in a text before it is cut,
as the library does. The word table belongs to a process and starts anew beyond TABLE_WORDS words or TABLE_IDS ids,
so memory is bounded; results do not depend on it.

Defined cases: a null text is the empty text, with no ids, and decodes to the empty text; nothing is cut, a very long
text or word is taken whole; repeated rows give equal rows; an empty table gives an empty result; other columns stay,
those named like a result column, in any letter case, give way; ids that the model does not have decode to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyloom.llm.common import drop_columns, in_arrow, scan_texts, texts_of
from tallyloom.llm.textscan import ranges

# Fixed value: the pattern by which byte-level models of this kind cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and ids that a process keeps; bytes from which a word is merged by the heap; bytes of text in a slice.
TABLE_WORDS, TABLE_IDS, LONG, SLICE = 300_000, 4_000_000, 512, 2 << 20
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself where it can be seen, else one above 255."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in seen)
    above = {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [above.get(b) or chr(b) for b in range(256)]


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """For each code point, whether it has no category in this Python's table."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def unknown_characters(text: str) -> bool:
    """Whether a text has characters whose category may differ between tables."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class Merges:
    """A model's merges as arrays: pair keys in order, with the rank and the product of each."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], n: int):
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * n + right, kind="stable")
        self.n = n
        self.keys = np.append((left * n + right)[order], _NONE)
        self.rank, self.product = order, made[order]
        self.letters = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        born = np.full(n, -1)
        born[made] = np.arange(len(made))
        # where every merge comes after those that make its parts, all occurrences of the lowest pair go at once
        self.ordered = len(np.unique(made)) == len(made) and bool(np.all(np.maximum(born[left], born[right]) < np.arange(len(made))))
        self._pairs: dict[int, tuple[int, int]] = {}

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number in each)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols, word = self.letters[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), size)
        done = []
        if len(long := np.flatnonzero(size > LONG)):
            begin = np.cumsum(size) - size
            for w in long.tolist():
                ids = self.one_by_one(symbols[begin[w] : begin[w] + size[w]].tolist())
                done.append((np.full(len(ids), w), np.array(ids, np.int64)))
            short = (size <= LONG)[word]
            symbols, word = symbols[short], word[short]
        while len(symbols):
            starts = np.concatenate(([True], word[1:] != word[:-1]))
            keys = symbols[:-1] * self.n + symbols[1:]
            at = np.searchsorted(self.keys, keys)
            known = (self.keys[at] == keys) & ~starts[1:]
            rank = np.full(len(symbols), _NONE)
            rank[:-1][known] = self.rank[at[known]]
            lowest, of = np.minimum.reduceat(rank, np.flatnonzero(starts)), np.cumsum(starts) - 1
            live = (lowest < _NONE)[of]
            done.append((word[~live], symbols[~live]))
            i = np.flatnonzero(live & (rank == lowest[of]))
            if not len(i):
                break
            run = np.concatenate(([True], i[1:] != i[:-1] + 1))  # pairs of one symbol with itself may overlap
            i = i[(i - i[run][np.cumsum(run) - 1]) % 2 == 0]
            if not self.ordered:
                i = i[np.concatenate(([True], of[i[1:]] != of[i[:-1]]))]
            symbols[i] = self.product[at[i]]
            live[i + 1] = False
            symbols, word = symbols[live], word[live]
        if not done:
            return np.zeros(0, np.int64), size
        whose = np.concatenate([w for w, _ in done])
        return np.concatenate([s for _, s in done])[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(raw))

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """A long word's ids: the lowest pair that stands furthest left is merged until there is none."""
        if not self._pairs:
            self._pairs = dict(zip(self.keys[:-1].tolist(), zip(self.rank.tolist(), self.product.tolist(), strict=True), strict=True))
        pairs, n, end = self._pairs, self.n, len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [p[0] << 40 | i for i in range(end - 1) if (p := pairs.get(symbols[i] * n + symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & (1 << 40) - 1, top >> 40
            j = after[i]
            if symbols[i] < 0 or j >= end:
                continue
            pair = pairs.get(symbols[i] * n + symbols[j])
            if pair is None or pair[0] != rank:  # one of the two has been merged since
                continue
            symbols[i], symbols[j] = pair[1], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if p := pairs.get(symbols[i] * n + symbols[k]):
                    heapq.heappush(heap, p[0] << 40 | i)
            h = before[i]
            if h >= 0 and (p := pairs.get(symbols[h] * n + symbols[i])):
                heapq.heappush(heap, p[0] << 40 | h)
        return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes and decodes with one byte-level BPE model of the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only byte-level BPE models without normaliser, dropout and affixes are known")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for their very text")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = model["vocab"]
        n = max([*vocabulary.values(), *self.added.values()]) + 1
        self.merges = Merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], n)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = regex.compile(WORDS)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        spelled = [b""] * n
        for token, i in [*vocabulary.items(), *self.added.items()]:
            spelled[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_size = np.fromiter(map(len, spelled), np.int64, n)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self._forget()

    def _forget(self) -> None:
        self.table = {}  # word: its place in the arrays below
        self.pool, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._enter(list(self.added), np.array(list(self.added.values()), np.int64), np.ones(len(self.added), np.int64))

    def _enter(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.table.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, ids.astype(np.int32)))

    def words(self, text: str) -> list[str]:
        """The words of a text in order, added tokens among them."""
        parts = self.split.split(text) if self.split and not self.added.keys().isdisjoint(self.split.findall(text)) else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif unknown_characters(part):
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            else:
                out += self.pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): text d has ids[bounds[d]:bounds[d + 1]]."""
        if len(self.table) > TABLE_WORDS or len(self.pool) > TABLE_IDS:
            self._forget()
        cut = [self.words(t) for t in texts]
        words = [w for some in cut for w in some]
        if new := [w for w in dict.fromkeys(words) if w not in self.table]:
            self._enter(new, *self.merges.segment(new))
        place = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        size = self.size[place]
        of = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(some) for some in cut]))).astype(np.int64)
        return self.pool[ranges(self.begin[place], size)], np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[of]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each ids[bounds[d]:bounds[d + 1]]."""
        known = (ids >= 0) & (ids < len(self.byte_size))
        size = np.zeros(len(ids), np.int64)
        size[known] = self.byte_size[ids[known]]
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[bounds].tolist()
        raw = self.bytes[ranges(self.byte_start[ids[known]], size[known])].tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with an array<int> of token ids. model: a path that every executor can open."""
    return scan_texts(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda c: [_lists(*encoder(model).encode(texts_of(c)))], slice_bytes=SLICE)


def decode(docs: DataFrame, model: str, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give the empty text."""
    source = drop_columns(docs, [text])
    at, names = source.columns.index(ids), [*source.columns, text]
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column(at).to_pylist()]
            bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in lists]))).astype(np.int64)
            made = encoder(model).decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    return in_arrow(source, run, schema)


def round_trip(docs: DataFrame, model: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers) and decoded_sha256, in one pass."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def columns_of(column: pa.Array) -> list[pa.Array | list]:
        one, hash_of = encoder(model), hashlib.sha256
        ids, bounds = one.encode(texts_of(column))
        raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
        return [
            pa.array(np.diff(bounds)), [hash_of(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)],
            [hash_of(t.encode()).hexdigest() for t in one.decode(ids, bounds)],
        ]

    return scan_texts(docs, text, fields, columns_of, keep=keep, slice_bytes=SLICE)
