"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every term has a fixed sparse index vector derived from its hash. A term's vector is the sum of the index vectors
of the terms around it in the fit documents, normalised; a document's is the mean over its terms. A table holds the
vectors of the most frequent terms of the fit documents; every other term, met there or not, stands for itself by its
index vector, which needs no table. Two kinds of terms are pooled side by side: words (letters lower-cased in ASCII,
other bytes as they are) and shapes (the word's character classes with runs collapsed, and whether it repeats the word
before). The network has one hidden layer; its logits are divided by a temperature fitted on rows it was not trained on.

The classifier is fitted from a bounded sample of labelled rows: the first `fit_rows` in the order of a hash of the
id, at most `fit_bytes` of text. Their texts go to one task, which returns the model; the driver sees ids, sizes and
the model. Scoring covers every whole text in one pass without a shuffle; what is broadcast (at most `vocabulary`
vectors of each kind and the weights) does not grow with the data.

Defined cases: null and empty texts are scored from a zero vector; rows without an id or label, or with one that
is neither 0 nor 1, teach nothing; repeated rows each count; labelled texts that do not fit the sample are passed over;
ties in the order go by id, label, size and text hash; with no usable labels, or labels of one kind, every score is
that kind's share (0.5 without any); a very long text is scored whole; an empty table gives an empty result; labels,
language, source and id are never inputs of a score; other columns stay, one named like the score, in any letter case,
gives way.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import in_arrow, scan_texts
from tallyloom.llm.textscan import WHITE, ascii_lower_table, chunks, mix, scan, separator_table, span_hashes

FIT_ROWS, FIT_BYTES = 6_000, 16 << 20
VOCABULARY, DIM, NONZERO, REACH = 30_000, 32, 4, 2
HIDDEN, EPOCHS, SEED = 32, 200, 11
SEPARATORS = separator_table(WHITE)
LOWER = ascii_lower_table()
_U = np.uint64


def _classes() -> np.ndarray:
    """Character classes of bytes: letters (small, capital), digits, bytes beyond ASCII as small letters, and each other sign by itself."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    return out


CLASSES = _classes()


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word terms, shape terms, counts of each text) of the chunks of a column."""
    for _, _, data, offsets in chunks(column):
        words = scan(data, offsets, SEPARATORS)
        word = span_hashes(LOWER[data], words.starts, words.ends)
        kind = CLASSES[data]
        fresh = np.ones(len(data), dtype=bool)
        fresh[1:] = kind[1:] != kind[:-1]
        fresh[words.starts] = True
        rank = np.concatenate((np.zeros(1, np.int64), np.cumsum(fresh)))
        shape = span_hashes(kind[fresh], rank[words.starts], rank[words.ends])
        again = np.zeros(len(word), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & (words.doc[1:] == words.doc[:-1])
        yield word, np.where(again, mix(shape, 9), shape), words.per_doc


def index_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Sparse vectors of +1 and -1 in places that follow from the codes."""
    out = np.zeros((len(codes), dim), np.int8)
    row = np.arange(len(codes))
    for places, signs in _index_places(codes, dim):
        out[row, places] += signs.astype(np.int8)
    return out


def _index_places(codes: np.ndarray, dim: int = DIM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, signs) of the first, second, ... entry of the codes' index vectors."""
    for i in range(NONZERO):
        h = mix(codes, 20 + i)
        yield (h % _U(dim)).astype(np.int64), np.where(h >> _U(63), 1, -1)


@dataclass
class Vectors:
    """Sorted term codes with their vectors."""

    codes: np.ndarray
    vectors: np.ndarray

    @classmethod
    def learn(cls, codes: np.ndarray, per_doc: np.ndarray, most: int = VOCABULARY) -> Vectors:
        known, flat, count = np.unique(codes, return_inverse=True, return_counts=True)
        top = np.sort(np.lexsort((known, -count))[:most])
        slot = np.full(len(known), -1, np.int64)
        slot[top] = np.arange(len(top))
        at = slot[flat]
        context = np.zeros((len(top), DIM), np.float64)
        index = index_vectors(known)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        for step in range(1, REACH + 1):
            near = doc[step:] == doc[:-step]
            for to, by in ((at[step:][near], flat[:-step][near]), (at[:-step][near], flat[step:][near])):
                ok = to >= 0
                for d in range(DIM):
                    context[:, d] += np.bincount(to[ok], weights=index[by[ok], d], minlength=len(top))
        context += index[top]
        size = np.linalg.norm(context, axis=1, keepdims=True)
        return cls(known[top], (context / np.maximum(size, 1e-9)).astype(np.float32))

    def pooled(self, codes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Mean vector of each text's terms, and the share of terms that the table holds."""
        out = np.zeros((len(per_doc), DIM + 1), np.float32)
        if not len(codes):
            return out
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        known = np.zeros(len(codes), dtype=bool)
        if len(self.codes):
            place = np.searchsorted(self.codes, codes)
            place[place == len(self.codes)] = 0
            known = self.codes[place] == codes
            mine, at = place[known], doc[known]
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                rows, ends = at[first], np.r_[first[1:], len(at)]
                for a in range(0, len(first), 256):  # a few texts' vectors at once
                    b = min(len(first), a + 256)
                    out[rows[a:b], :DIM] = np.add.reduceat(self.vectors[mine[first[a] : ends[b - 1]]], first[a:b] - first[a], axis=0)
                out[rows, DIM] = ends - first
        if not known.all():
            rest, at = codes[~known], doc[~known] * DIM
            flat = np.zeros(len(per_doc) * DIM)
            for places, signs in _index_places(rest):
                flat += np.bincount(at + places, weights=signs / np.sqrt(NONZERO), minlength=len(flat))
            out[:, :DIM] += flat.reshape(-1, DIM).astype(np.float32)
        return out / np.maximum(per_doc, 1)[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the rest fits the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-2
    z = ((x - mean) / scale).astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(EPOCHS):
        rows = rng.permutation(fit)
        for a in range(0, len(rows), 512):
            b = rows[a : a + 512]
            h = np.tanh(z[b] @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3][0]) - y[b]) / len(b)
            back = np.outer(d, p[2]) * (1 - h * h)
            grad = [z[b].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(hold):
        logit, t = net.logits(x[hold]), y[hold]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
        loss = [-np.mean(t * np.log(_sigmoid(logit / c) + 1e-9) + (1 - t) * np.log(1 - _sigmoid(logit / c) + 1e-9)) for c in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    words: Vectors | None
    shapes: Vectors | None
    network: Network | None
    share: float = 0.5

    def features(self, word: np.ndarray, shape: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        return np.hstack((self.words.pooled(word, per_doc), self.shapes.pooled(shape, per_doc)))

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.share)
        return np.concatenate([self.network.scores(self.features(*t)) for t in terms(column)] or [np.zeros(0)])


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, None, float(y.mean()) if len(y) else 0.5)
    parts = list(terms(pa.array([t for t, _ in rows], pa.string())))
    word, shape, per_doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    model = Model(Vectors.learn(word, per_doc), Vectors.learn(shape, per_doc), None, float(y.mean()))
    model.network = train(model.features(word, shape, per_doc), y)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from fitting: the CRC-32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> DataFrame | None:
    """(place, y, t): at most fit_rows labelled rows and fit_bytes of whole texts, in the order of a hash of the id; None if there are none."""
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(order, "id", "y").limit(fit_rows)
    # sizes first, so that no more than fit_bytes of text ever meet
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")  # fit_rows rows at most
    texts = texts.select("id", "y", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"), "t")
    sizes = texts.drop("t").orderBy(order, "id", "y", "n", "h").limit(fit_rows).collect()
    taken, size = [], 0
    for row in sizes:
        if size + row.n <= fit_bytes:  # a text that does not fit is passed over, those after it may
            size += row.n
            taken.append((len(taken), row.id, row.y, row.h))
    if not taken:
        return None
    wanted = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("place", T.IntegerType()), *texts.select("id", "y", "h").schema.fields]))
    key = ["id", "y", "h"]
    # repeated rows come once
    found = texts.join(F.broadcast(wanted.select(*key).distinct()), key, "left_semi").groupBy(*key).agg(F.min("t").alias("t"))  # fit_rows rows at most
    return found.join(F.broadcast(wanted), key).select("place", "y", "t")


def fit_sample(docs: DataFrame, labels: DataFrame, **options) -> list[tuple[str, int]]:
    """The sample's (text, label) rows, on the driver."""
    rows = sample(docs, labels, **options)
    return [] if rows is None else [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: r.place)]


def fitted(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the labelled rows' sample, fitted in one task."""
    rows = sample(docs, labels, **options)
    if rows is None:
        return fit([])

    def run(batches):
        held = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda row: row[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, y, t in held]))], pa.binary())], names=["model"])

    return pickle.loads(in_arrow(rows.coalesce(1), run, "model binary").first()["model"])


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with the score of every text, 0 to 1; higher: label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scan_texts(docs, text, [T.StructField(column, T.DoubleType())], lambda c: [pa.array(shared.value.scores(c), pa.float64())], keep=keep)


def crc_mod5(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
