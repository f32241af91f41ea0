"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles (A-Z lower-cased words); with fewer words than a shingle, the
whole sequence is one. Two documents link when q * |A and B| >= p * |A or B| for a similarity p/q; no document
without words links. All results are exact, but for 64-bit hashes of shingles and sets.

1. Documents of equal sets form one class; only one text of a class goes on (copies never meet pairwise).
2. Similar classes are brought together. A pair that links differs in at most D tokens, and D follows from the
   sizes. Sizes fall into levels; on a level each set is cut by token hash into k > D slices, so at least k - D
   slices are equal, and the D + 1 fullest slices of both (a prefix under one global order) must share one.
   Tokens that very many documents hold (a bounded, broadcast set; which ones only matters for speed) are left
   out of the slices, since leaving tokens out never raises the difference. Classes that share a slice are
   joined to one partition of similar documents; no link crosses partitions. Classes of a batch that share a slice
   are joined there and then, and the batch sends each slice once: a slice that a third of all documents share
   comes to its task as one entry a batch, not one a document. An entry has 11 bytes, six of the code and five of
   the class: what is taken for equal thereby only shares a partition, where texts are compared.
   Passages that many texts share bring together what cannot link, more of it the larger the input is. So of the
   partitions of more than `group_tokens` tokens, classes are first left out of which more tokens than a linked set
   may miss are in no other class (counted on a share of all tokens, by hash), and the rest is placed anew.
3. What still has more than `group_tokens` tokens is dealt by size into groups that fit in memory. Groups are joined
   by themselves first; then one member of each component of each group (a hub) meets the others' hubs. Only where a
   partition still has several components are its classes dealt again, by component and size, and the pairs of
   groups that may hold a link (sizes within the similarity, not all of one component) are separate tasks. So near
   copies by the million cost about one pass, and pairs are left for sets that were brought together but do not link.
   Within a task, documents form small groups of like size; the matrix of tokens by groups holds each group's token
   union. A query opens a group only if its overlap with the union reaches what the similarity asks for; only then
   are members intersected. Members already known to be connected are not opened. A task returns a spanning forest,
   never pairs.
4. Links go through connected components again; a component's id is its smallest document id.

Defined cases: null and empty texts have an empty set and stand alone (component_id is their own id); a null id
takes part in links but never is a component's id unless all ids there are null, which gives null; repeated
rows are copies; of documents with equal ids the texts are told apart; ties at exactly the similarity link; a very
long text is one set, taken whole; an empty table gives an empty result; other columns are kept out of components
and stay as they are in drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import in_arrow, materialize, only_last, own
from tallyloom.llm.components import connected, forest
from tallyloom.llm.textscan import WHITE, ascii_lower_table, chunks, mix, rolled, scan, separator_table, window_starts

SEPARATORS = separator_table(WHITE)
LOWER = ascii_lower_table()
GROUP_TOKENS = 100_000
#: Documents of one column group of the matrix.
GROUP_DOCS = 64
#: A token in more than this share of documents is left out of slices; at most so many tokens are.
HOT_SHARE, HOT_MOST = 0.004, 65_536
#: Bytes of slices that one task sorts.
SLICE_TASK_BYTES = 24 << 20
#: Bits of the bitmap of texts to fetch (8 MB): its size never grows; with very many keys it only sifts less.
MARK_BITS = 1 << 26
#: Slices that a batch joins and sends at once.
FLUSH_SLICES = 1 << 20
EDGES, SLICES = 0, 1
#: Bytes of a slice's code and of a class that are sent. The task that a slice comes to tells codes apart too.
CODE_BYTES, NAME_BYTES = 6, 5
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingle width and the similarity p/q."""

    width: int = 5
    p: int = 8
    q: int = 10

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.q * both >= self.p * (a + b - both)

    def levels(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lowest size, D, k) of each level that sizes up to most need."""
        low, diff, cut, at = [], [], [], 1
        while at <= most:
            high = max(at, at * self.q // self.p)
            d = (high + high * self.q // self.p) * (self.q - self.p) // (self.q + self.p)
            low.append(at)
            diff.append(d)
            cut.append(d + 1 + -(-3 * (d + 1) // 10))
            at = high + 1
        return np.array(low, np.int64), np.array(diff, np.int64), np.array(cut, np.int64)


def token_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin row, end row, tokens, sizes): sorted distinct tokens of each text, one after another."""
    for begin, end, data, offsets in chunks(column):
        words = scan(LOWER[data], offsets, SEPARATORS)
        hashes = words.hashes()
        starts, _ = window_starts(words.per_doc, words.first, width)
        grams = rolled(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
        count = np.maximum(words.per_doc - width + 1, 0)
        at = np.cumsum(count) - count
        sets = []
        for d, (n, c, a, f) in enumerate(zip(words.per_doc.tolist(), count.tolist(), at.tolist(), words.first.tolist(), strict=True)):
            if c:
                t = np.sort(grams[a : a + c])
                keep = np.empty(c, dtype=bool)
                keep[0] = True
                np.not_equal(t[1:], t[:-1], out=keep[1:])
                sets.append(t[keep])
            else:
                sets.append(rolled(hashes[f : f + n], n, seed=n) if n else np.zeros(0, np.uint64))
        yield begin, end, np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        end = np.cumsum(sizes)
        return total[end] - total[end - sizes]


def class_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        return mix(_sums(mix(tokens, 1), sizes) + sizes.astype(np.uint64), 2).view(np.int64)


def _thin(docs: DataFrame, doc_id: str, text: str, rule: Rule, marked: bool) -> DataFrame:
    """A row (kind 0, key, doc_id, n, cls, mark) for each document; rows (kind 1, n, cls) for tokens common within a batch. mark: a hash of the text, if asked for."""
    keyed = _keyed(docs, doc_id, text).withColumn("mark", F.xxhash64("text") if marked else F.lit(None).cast("long"))

    def run(batches):
        for batch in batches:
            for begin, end, tokens, sizes in token_sets(batch.column(2), rule.width):
                rows = end - begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), batch.column(0).slice(begin, rows), batch.column(1).slice(begin, rows), pa.array(sizes), pa.array(class_of(tokens, sizes)), batch.column(3).slice(begin, rows)],
                    names=["kind", "key", "doc_id", "n", "cls", "mark"],
                )
                t, c = np.unique(tokens, return_counts=True)
                often = c >= max(4, HOT_SHARE * rows)
                if often.any():
                    m = int(often.sum())
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, pa.array(c[often].astype(np.int64)), pa.array(t[often].view(np.int64)), none], names=["kind", "key", "doc_id", "n", "cls", "mark"])

    return in_arrow(keyed, run, "kind int, key long, doc_id long, n long, cls long, mark long")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, text). For a null id the key, below 0, comes from the text: it is the same however the rows are split when they are read again."""
    own = F.col(doc_id).cast("long")
    return docs.select(F.coalesce(own, -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62))).alias("key"), own.alias("doc_id"), F.col(text).alias("text"))


def slice_codes(tokens: np.ndarray, sizes: np.ndarray, wide: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(code, index of the set) of the slices that stand for each set. wide: the sets' sizes with left-out tokens."""
    low, diff, cut = rule.levels(int(wide.max(initial=1)))
    level = np.searchsorted(low, wide, side="right") - 1
    codes, owners = [], []
    spread, value = mix(tokens, 3), mix(tokens, 4)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for back in (0, 1):
        at = level - back
        use = (at >= 0) & (diff[np.maximum(at, 0)] > 0) & (wide > 0)
        if not use.any():
            continue
        d, k = np.where(use, diff[np.maximum(at, 0)], 0), np.where(use, cut[np.maximum(at, 0)], 0)
        base = np.cumsum(k) - k
        total = int(k.sum())
        mine = use[doc]
        own = doc[mine]
        place = base[own] + (spread[mine] % k[own].astype(np.uint64)).astype(np.int64)
        acc, count = np.zeros(total, np.uint64), np.bincount(place, minlength=total)
        with np.errstate(over="ignore"):
            np.add.at(acc, place, value[mine])
            owner = np.repeat(np.arange(len(sizes)), k)
            j = np.arange(total) - base[owner]
            code = mix(acc + mix((at[owner].astype(np.uint64) << _U(32)) + j.astype(np.uint64), 5), 6)
        # one order for all sets of a level: fullest first, then by code
        order = np.argsort((owner.astype(np.uint64) << _U(40)) | ((_U(255) - np.minimum(count, 255).astype(np.uint64)) << _U(32)) | (code >> _U(32)), kind="stable")
        rank = np.arange(total) - base[owner]
        taken = order[rank <= d[owner]]
        codes.append(code[taken])
        owners.append(owner[taken])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def _sent(code: np.ndarray, cls: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (kind, part, block): classes that share a slice, joined, and each slice with its smallest class."""
    order = np.lexsort((cls, code))
    code, cls = code[order], cls[order]
    new = np.r_[True, code[1:] != code[:-1]]
    a, b = forest(cls, cls[np.flatnonzero(new)[np.cumsum(new) - 1]])
    code, cls = code[new], cls[new]
    part = (code % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    code, cls, part = code[order], cls[order], part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = [code[x:y].tobytes() + cls[x:y].tobytes() for x, y in zip(cut.tolist(), np.r_[cut[1:], len(part)].tolist(), strict=True)]
    kinds, to = [SLICES] * len(cut), part[cut]
    if len(a):
        kinds, to, blobs = [EDGES, *kinds], np.r_[int(code[0] % _U(parts)), to], [a.tobytes() + b.tobytes(), *blobs]
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "part", "block"])


def _planes(values: np.ndarray, first: int, last: int) -> bytes:
    """Bytes first to last of values, the lowest byte being 0, a byte at a time: the high bytes of sorted codes compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, first:last].T).tobytes()


def _of_planes(blob: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = blob.reshape(width, -1).T
    return out.view("<u8").ravel()


def packed(blob: bytes) -> bytes:
    """A block of slices, 11 bytes each instead of 16: the high bytes of codes, then classes."""
    both = np.frombuffer(blob, np.uint64)
    half = len(both) // 2
    return _planes(both[:half], 8 - CODE_BYTES, 8) + _planes(both[half:], 0, NAME_BYTES)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(high bytes of codes, classes) of a packed block."""
    flat = np.frombuffer(blob, np.uint8)
    cut = len(flat) // (CODE_BYTES + NAME_BYTES) * CODE_BYTES
    return _of_planes(flat[:cut], CODE_BYTES), _of_planes(flat[cut:], NAME_BYTES).view(np.int64)


def _thinner(sent: pa.RecordBatch) -> pa.RecordBatch:
    blobs = [packed(b) if k == SLICES else b for k, b in zip(sent.column(0).to_pylist(), sent.column(2).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), pa.array(blobs, pa.binary())], names=["kind", "part", "block"])


def name_of(cls: np.ndarray) -> np.ndarray:
    """The high NAME_BYTES bytes of classes. Classes that share them come to one partition, where they are told apart: no link is lost or made."""
    return (cls.view(np.uint64) >> _U(64 - 8 * NAME_BYTES)).view(np.int64)


def _blocks(texts: DataFrame, rule: Rule, hot: list[int], parts: int) -> DataFrame:
    """(kind, part, block) of texts (key, text): packed (slice code, name of the class) pairs of a batch, and edges between its classes' names."""
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))

    def run(batches):
        left_out = shared.value
        for batch in batches:
            codes, classes, held, done = [], [], 0, np.zeros(0, np.int64)
            for _, _, tokens, sizes in token_sets(batch.column(1), rule.width):
                cls = class_of(tokens, sizes)
                known, first = np.unique(cls, return_index=True)
                alone = np.zeros(len(sizes), dtype=bool)
                alone[first] = ~np.isin(known, done)  # a class once a batch
                done = np.union1d(done, known)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                keep = alone[doc]
                if len(left_out):
                    place = np.searchsorted(left_out, tokens)
                    place[place == len(left_out)] = 0
                    keep &= left_out[place] != tokens
                code, owner = slice_codes(tokens[keep], np.bincount(doc[keep], minlength=len(sizes)), np.where(alone, sizes, 0), rule)
                codes.append(code)
                classes.append(name_of(cls)[owner])
                held += len(code)
                if held >= FLUSH_SLICES:
                    yield _thinner(_sent(np.concatenate(codes), np.concatenate(classes), parts))
                    codes, classes, held = [], [], 0
            if held:
                yield _thinner(_sent(np.concatenate(codes), np.concatenate(classes), parts))

    return in_arrow(texts, run, "kind int, part long, block binary")


def _looked_at(texts: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """(part, block) of texts (key, text): packed (code of a token, class) pairs, for a share of all tokens that is twice what a linked set may have alone."""
    taken = min(rule.q, 2 * (rule.q - rule.p))

    def packs(codes, classes):
        code, cls = np.concatenate(codes), np.concatenate(classes)
        part = (code % _U(parts)).astype(np.int64)
        order = np.lexsort((code, part))
        code, cls, part = code[order], cls[order], part[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [_planes(code[x:y], 8 - CODE_BYTES, 8) + cls[x:y].tobytes() for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(blobs, pa.binary())], names=["part", "block"])

    def run(batches):
        codes, classes, held = [], [], 0
        for batch in batches:
            for _, _, tokens, sizes in token_sets(batch.column(1), rule.width):
                use = mix(tokens, 9) % _U(rule.q) < _U(taken)
                codes.append(mix(tokens[use], 10))
                classes.append(np.repeat(class_of(tokens, sizes), sizes)[use])
                held += len(codes[-1])
                if held >= FLUSH_SLICES:
                    yield packs(codes, classes)
                    codes, classes, held = [], [], 0
        if held:
            yield packs(codes, classes)

    return in_arrow(texts, run, "part long, block binary")


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, alone): of a class's tokens that come to this task, the number that no other class has."""
    codes, classes = [], []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            cut = len(blob) // (CODE_BYTES + 8) * CODE_BYTES
            codes.append(_of_planes(np.frombuffer(blob, np.uint8, count=cut), CODE_BYTES))
            classes.append(np.frombuffer(blob, np.int64, offset=cut))
    if codes:
        code, cls = np.concatenate(codes), np.concatenate(classes)
        order = np.lexsort((cls, code))
        code, cls = code[order], cls[order]
        once = np.r_[True, (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])]
        code, cls = code[once], cls[once]
        new = np.r_[True, code[1:] != code[:-1]]
        names, counts = np.unique(cls[new & np.r_[new[1:], True]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], names=["cls", "alone"])


def _marks(keys: DataFrame) -> np.ndarray:
    """A bitmap of MARK_BITS bits, whatever the number of keys: which texts may be asked for. Joined by `or` in two steps on executors."""

    def mark(batches):
        marks = np.zeros(MARK_BITS, dtype=bool)
        for batch in batches:
            marks[_mark_of(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([int(marks.sum()) % 1024], pa.int32()), pa.array([zstandard.compress(np.packbits(marks).tobytes(), 1)], pa.binary())], names=["at", "marks"])

    def either(batches):
        marks = np.zeros(MARK_BITS // 8, np.uint8)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                marks |= np.frombuffer(zstandard.decompress(blob), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zstandard.compress(marks.tobytes(), 1)], pa.binary())], names=["at", "marks"])

    shape = "at int, marks binary"
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for row in in_arrow(in_arrow(keys, mark, shape).repartition(8, "at"), either, shape).toLocalIterator():
        out |= np.frombuffer(zstandard.decompress(bytes(row["marks"])), np.uint8)
    return out


def _mark_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 8) % _U(MARK_BITS)).astype(np.int64)


def _sifted(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """texts (key, text) without most of those that no task asks for, so that the join moves few others."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = _mark_of(batch.column(0).to_numpy())
            asked = batch.rename_columns(["key", "text"]).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            if len(pc.unique(asked.column(0))) < asked.num_rows:  # rows that repeat id and text, or a text without an id
                yield from pa.Table.from_batches([asked]).group_by(["key", "text"]).aggregate([]).to_batches()
            else:
                yield asked

    return in_arrow(texts, run, texts.schema)


def _parted(docs: DataFrame, key: Column, marks: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key is marked, all others), told apart where they are read: the others need no join."""
    shared, arrow = docs.sparkSession.sparkContext.broadcast(marks), to_arrow_schema(docs.schema)

    def side(asked: bool):
        def run(batches):
            bits = shared.value
            for batch in batches:
                at = _mark_of(batch.column(0).to_numpy())
                hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns[1:], arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(hit == asked))

        return run

    keyed = docs.select(key.alias(own("key")), *[F.col(f"`{c}`") for c in docs.columns])
    return tuple(in_arrow(keyed, side(asked), docs.schema) for asked in (True, False))


def _shared_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the classes that share a slice, and those that batches have joined, to a spanning forest. A task gets the slices of one part."""
    codes, classes, ends = [], [], ([], [])
    for batch in batches:
        for kind, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind == EDGES:
                half = len(blob) // 2
                ends[0].append(np.frombuffer(blob, np.int64, count=half // 8))
                ends[1].append(np.frombuffer(blob, np.int64, offset=half))
            else:
                code, cls = unpacked(blob)
                codes.append(code)
                classes.append(cls)
    if codes:
        code, cls = np.concatenate(codes), np.concatenate(classes)
        order = np.lexsort((cls, code))
        code, cls = code[order], cls[order]
        new = np.r_[True, code[1:] != code[:-1]]
        first = cls[np.flatnonzero(new)[np.cumsum(new) - 1]]
        ends[0].append(cls[~new])
        ends[1].append(first[~new])
    if ends[0]:
        a, b = forest(np.concatenate(ends[0]), np.concatenate(ends[1]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def join_group(cls: np.ndarray, side: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, rule: Rule, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between sets of one task. side 2: pairs within; 0 and 1: pairs across sides only. known: components that are known."""
    order = np.lexsort((cls, sizes))
    at = (np.cumsum(sizes) - sizes)[order]
    cls, side, sizes = cls[order], side[order], sizes[order]
    vocabulary, ids = np.unique(tokens, return_inverse=True)
    sets = [ids[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
    count = len(sets)
    links_a, links_b = [], []
    root = np.arange(count)
    if known is not None:
        _, first, which = np.unique(known[order], return_index=True, return_inverse=True)
        root = first[which]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    column = np.full(len(vocabulary), -1, np.int64)
    for g in range(0, count, GROUP_DOCS):
        members = range(g, min(count, g + GROUP_DOCS))
        union = np.unique(np.concatenate([sets[i] for i in members]))
        column[union] = np.arange(len(union))
        matrix = np.zeros((len(members), len(union)), dtype=np.uint8)
        for r, i in enumerate(members):
            matrix[r, column[sets[i]]] = 1
        smallest, largest = int(sizes[g]), int(sizes[members[-1]])
        member_sizes, member_side = sizes[g : members[-1] + 1], side[g : members[-1] + 1]
        # queries: this group and all larger sets that can still be similar to its largest one
        last = int(np.searchsorted(sizes, largest * rule.q // rule.p, side="right"))
        queries = np.arange(g, last)
        lengths = sizes[g:last]
        flat = np.concatenate([column[sets[i]] for i in queries]) if len(queries) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(queries)), lengths)
        bound = np.bincount(owner[flat >= 0], minlength=len(queries))
        # |Q and S| >= p/q * |Q or S| >= p/q * |Q|
        open_ = np.flatnonzero(rule.q * bound >= rule.p * lengths)
        ends = np.cumsum(lengths)
        for x in open_.tolist():
            i = g + x
            near = flat[ends[x] - lengths[x] : ends[x]]
            fits = (rule.q * member_sizes >= rule.p * lengths[x]) & (np.arange(len(members)) < i - g)
            if side[i] != 2:
                fits &= member_side != side[i]
            if not fits.any():
                continue
            mine = find(i)
            rows = [r for r in np.flatnonzero(fits).tolist() if find(g + r) != mine]
            if not rows:
                continue
            rows = np.array(rows)
            both = matrix[rows][:, near[near >= 0]].sum(axis=1, dtype=np.int64)
            for r in rows[rule.links(both, member_sizes[rows], np.int64(lengths[x]))].tolist():
                a, b = find(i), find(g + r)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links_a.append(i)
                    links_b.append(g + r)
        column[union] = -1
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(cls[links_a], cls[links_b])


def _verify(table: pa.Table, rule: Rule) -> pa.Table:
    """Links within a task's rows (cls, text, and side and root where they are given)."""
    column = table.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    tokens, sizes = [], []
    for _, _, t, s in token_sets(column, rule.width):
        tokens.append(t)
        sizes.append(s)
    tokens, sizes = np.concatenate(tokens), np.concatenate(sizes)
    cls, names = table.column("cls").to_numpy(), table.column_names
    side = table.column("side").to_numpy() if "side" in names else np.full(len(cls), 2)
    real = class_of(tokens, sizes) == cls  # repeated ids may bring another text along
    _, first = np.unique(np.where(real, cls, 0), return_index=True)
    keep = np.zeros(len(cls), dtype=bool)
    keep[first] = True
    keep &= real
    a = b = np.zeros(0, np.int64)
    if keep.sum() > 1:
        known = table.column("root").to_numpy()[keep] if "root" in names else None
        a, b = join_group(cls[keep], side[keep], tokens[np.repeat(keep, sizes)], sizes[keep], rule, known)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame, bool]:
    """(rows with `grp` and `dealt`, whether any was dealt): rows (cls, n, ...) of like `by`, dealt by size into groups of about `most` tokens."""
    one = Window.partitionBy(*by)
    hist = rows.groupBy(*by, "n").agg(F.sum("n").alias("t"))  # a row for each size
    hist = hist.withColumns({"before": F.coalesce(F.sum("t").over(one.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "every": F.sum("t").over(one)})
    large = materialize(hist.where(F.col("every") > most).select(*by, "n", F.floor(F.col("before") / most).alias("base"), F.ceil(F.col("t") / most).alias("spread")))
    if large.isEmpty():
        return rows.withColumns({"grp": F.lit(0).cast("long"), "dealt": F.lit(False)}), False
    met = rows.join(large, [*by, "n"], "left")
    grp = F.coalesce(F.col("base") + F.pmod(F.xxhash64("cls"), F.col("spread")), F.lit(0))
    return met.withColumns({"grp": grp, "dealt": F.col("base").isNotNull()}).drop("base", "spread"), True


def _hub_links(members: DataFrame, texts: DataFrame, rule: Rule, most: int) -> DataFrame:
    """Links between one member of each component (root) of each group and those of other groups."""
    hubs = members.groupBy("part", "grp", "root").agg(F.min(F.struct("cls", "n")).alias("hub")).select("part", "hub.cls", "hub.n")
    hubs, _ = _dealt(hubs, ["part"], most)
    met = hubs.select("part", "grp", "cls").join(texts.select("part", "cls", "text"), ["part", "cls"])
    return met.groupBy("part", "grp").applyInArrow(lambda t: _verify(t, rule), "a long, b long")


def _pair_links(members: DataFrame, texts: DataFrame, rule: Rule, most: int) -> DataFrame:
    """Links between classes of different components of a partition: pairs of groups are tasks.

    A component of more than `most` tokens has groups of its own, which need no pairs among themselves; the others of a
    partition are dealt together.
    """
    sizes = members.groupBy("part", "root").agg(F.sum("n").alias("tokens"))
    several = sizes.groupBy("part").agg(F.count("*").alias("roots")).where("roots > 1").select("part")
    home = sizes.join(several, "part").select("part", "root", F.when(F.col("tokens") > most, F.col("root")).otherwise(0).alias("home"), (F.col("tokens") > most).alias("major"))
    rows, _ = _dealt(members.drop("grp").join(home, ["part", "root"]), ["part", "major", "home"], most)
    rows = materialize(rows.select("part", "major", "home", "grp", "cls", "root", "n"))
    groups = rows.groupBy("part", "major", "home", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    groups = materialize(groups.withColumn("g", F.struct("major", "home", "grp")).select("part", "g", "home", "major", "low", "high", "r0", "r1"))
    x, y = (groups.select("part", *[F.col(c).alias(f"{k}_{c}") for c in ("g", "home", "major", "low", "high", "r0", "r1")]) for k in "xy")
    fits = (rule.q * F.col("x_high") >= rule.p * F.col("y_low")) & (rule.q * F.col("y_high") >= rule.p * F.col("x_low"))
    minor = x.where("not x_major").join(y, "part").where(F.col("y_major") | (F.col("x_g") <= F.col("y_g")))
    minor = minor.where((F.col("x_g") != F.col("y_g")) | (F.col("x_r0") != F.col("x_r1")))
    # components with groups of their own meet by component first, so that their own groups never do
    major = groups.where("major").select("part", "home").distinct()
    apart = major.select("part", F.col("home").alias("x_home")).join(major.select("part", F.col("home").alias("y_home")), "part").where("x_home < y_home")
    both = apart.join(x.where("x_major"), ["part", "x_home"]).join(y.where("y_major"), ["part", "y_home"])
    pairs = minor.where(fits).select("part", "x_g", "y_g").unionByName(both.where(fits).select("part", "x_g", "y_g"))
    one = pairs.where("x_g = y_g").select("part", "x_g", "y_g", F.col("x_g").alias("g"), F.lit(2).alias("side"))
    two = pairs.where("x_g <> y_g")
    sides = [two.select("part", "x_g", "y_g", F.col(f"{k}_g").alias("g"), F.lit(i).alias("side")) for i, k in enumerate("xy")]
    tasks = one.unionByName(sides[0]).unionByName(sides[1])
    met = rows.withColumn("g", F.struct("major", "home", "grp")).select("part", "g", "cls", "root").join(tasks, ["part", "g"]).join(texts.select("part", "cls", "text"), ["part", "cls"])
    return met.select("part", "x_g", "y_g", "cls", "root", "side", "text").groupBy("part", "x_g", "y_g").applyInArrow(lambda t: _verify(t, rule), "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    found = roots.select(F.col("node").alias("cls"), "root")
    return materialize(members.drop("root").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls")))


def _tasks(tokens: float) -> int:
    return max(1, int(tokens * 16 / SLICE_TASK_BYTES) + 1)


def _placed(texts: DataFrame, classes: DataFrame, rule: Rule, hot: list[int], tokens: int) -> DataFrame:
    """(cls, part, key, n) of the classes that share a slice with others, texts (key, text) being theirs."""
    parts = _tasks(tokens * 2.2 * (rule.q - rule.p) / rule.p)  # slices a token, about
    edges = in_arrow(_blocks(texts, rule, hot, parts).repartitionById(parts, F.col("part").cast("int")), _shared_slices, "a long, b long")
    named = classes.withColumn("node", F.shiftrightunsigned("cls", 64 - 8 * NAME_BYTES))
    return connected(edges).select("node", F.col("root").alias("part")).join(named, "node").select("cls", "part", "key", "n")


def _apart(members: DataFrame, texts: DataFrame, rule: Rule, hot: list[int], most: int) -> DataFrame:
    """members (cls, part, key, n), partitions of more than `most` tokens without the classes that can have no link, and placed anew.

    Of a class that links, others have all tokens but n * (q - p) / q. A class of which more are found in no other class
    goes, whatever passages it shares; as its tokens no longer count, more may go the next time.
    """
    while True:
        large = members.groupBy("part").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > most).select("part")
        inside = materialize(members.join(large, "part", "left_semi").select("cls", "key", "n"))
        before = inside.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not before:
            return members
        parts = _tasks(before * min(1, 2 * (rule.q - rule.p) / rule.q))
        seen = _looked_at(_sifted(texts, _marks(inside.select("key"))), rule, parts)
        alone = in_arrow(seen.repartitionById(parts, F.col("part").cast("int")), _alone, "cls long, alone long").groupBy("cls").agg(F.sum("alone").alias("alone"))
        met = inside.join(alone, "cls", "left").where(rule.q * F.coalesce("alone", F.lit(0)) <= (rule.q - rule.p) * F.col("n"))
        left = materialize(met.select("cls", "key", "n"))
        after = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if after > 0.9 * before:  # near copies, in the main
            return members
        again = _placed(_sifted(texts, _marks(left.select("key"))), left, rule, hot, after)
        members = materialize(members.join(large, "part", "left_anti").unionByName(again.select(*members.columns)))


def _labelled(docs: DataFrame, doc_id: str, text: str, rule: Rule, group_tokens: int, marked: bool = False) -> DataFrame:
    """(doc_id, n, mark, group) of every row of docs: rows of a component have the same group."""
    thin = materialize(_thin(docs, doc_id, text, rule, marked))
    rows = thin.where("kind = 0")
    total, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = thin.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SHARE * total)
    hot = [r[0] for r in common.orderBy(F.desc("n"), "cls").limit(HOT_MOST).select("cls").collect()]

    texts = _keyed(docs, doc_id, text).select("key", "text")
    classes = rows.where("n > 0").groupBy("cls").agg(F.max("key").alias("key"), F.first("n").alias("n"))
    members = _apart(materialize(_placed(texts, classes, rule, hot, n_tokens)), texts, rule, hot, group_tokens)
    groups, dealt = _dealt(members, ["part"], group_tokens)
    texts = _sifted(texts, _marks(members.select("key")))
    candidates = texts.hint("shuffle_merge").join(groups, "key").select("part", "grp", "dealt", "n", "cls", "text")
    if dealt:
        candidates = materialize(candidates)
    links = materialize(candidates.drop("dealt").groupBy("part", "grp").applyInArrow(lambda t: _verify(t, rule), "a long, b long"))
    if dealt:
        candidates = candidates.where("dealt")  # no other texts move again
        large = candidates.groupBy("part").agg(F.max("grp").alias("last")).where("last > 0").select("part")
        members = candidates.select("part", "grp", "n", "cls").distinct().join(large, "part")
        members = _rooted(members, connected(links))
        links = links.unionByName(materialize(_hub_links(members, candidates, rule, group_tokens)))
        members = _rooted(members, connected(links))
        links = links.unionByName(materialize(_pair_links(members, candidates, rule, group_tokens)))
    roots = connected(links).select(F.col("node").alias("cls"), "root")

    return rows.join(roots, "cls", "left").select("doc_id", "n", "mark", F.coalesce("root", "cls").alias("group"))


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule(), group_tokens: int = GROUP_TOKENS) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id) of every row of docs."""
    labelled = _labelled(docs, doc_id, text, rule, group_tokens).drop("mark")
    # as a table of its own: a component that holds a third of all rows can then be split where rows meet its id
    ids = materialize(labelled.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("least")))
    return labelled.join(ids, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule(), group_tokens: int = GROUP_TOKENS) -> DataFrame:  # noqa: B008
    """docs with one row of each component, one of the smallest id (a null id counts as the largest); rows without words all stay.

    Rows are told apart by id and a 64-bit hash of the text, so rows that share only an id are judged one by one, and
    of rows that share both one stays. All columns stay as they are.
    """
    i, m = own("id"), own("mark")
    with only_last(docs.sparkSession):
        rows = materialize(_labelled(docs, doc_id, text, rule, group_tokens, marked=True).where("n > 0").select(F.col("doc_id").alias(i), F.col("mark").alias(m), "group"))
    # tables of their own, as in components
    first = materialize(rows.groupBy("group").agg(F.min(F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(m).alias("mark"))).alias("first")))
    is_first = F.col(i).eqNullSafe(F.col("first.id")) & (F.col(m) == F.col("first.mark"))
    met = rows.join(first, "group").select(i, m, is_first.alias("is_first"))
    # ids and texts of rows that go, and of those of which one stays
    judged = materialize(met.groupBy(i, m, "is_first").agg(F.count("*").alias("copies")).where("not is_first or copies > 1").drop("copies"))
    repeated = judged.where("is_first")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, mark = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    asked, others = _parted(docs, F.xxhash64(key, mark), _marks(judged.select(F.xxhash64(i, m))))
    keyed = asked.withColumn(i, key).withColumn(m, mark)

    def same(keys: DataFrame) -> Column:
        return keyed[i].eqNullSafe(keys[i]) & (keyed[m] == keys[m])

    kept = others.union(keyed.join(judged, same(judged), "left_anti").select(*columns))
    if repeated.isEmpty():
        return kept
    return kept.union(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates([i, m]).select(*columns))
