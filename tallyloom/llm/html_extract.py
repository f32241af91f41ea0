"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Blocks (html_blocks) are labelled main text or not from features of their ancestors and their own text, and from
the label of the block before; the field is trained by stochastic gradient on labelled pages (html_pages) and a
page is decoded by Viterbi. Training takes a second or two on the driver and does not depend on the data; what is
broadcast are the weights. Pages are scanned whole in one pass without a shuffle.

Defined cases: a null or empty page has an empty text; so has one without main text; broken markup is read as far
as it goes, by the rules of html_blocks; a very long page is read whole, in time linear in it; repeated rows give equal
rows; an empty table gives an empty result; other columns stay, those named like a result column, in any letter case,
give way.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm.common import scan_texts, texts_of
from tallyloom.llm.html_blocks import blocks
from tallyloom.llm.html_pages import labelled_page

PAGES, EPOCHS, SEED = 1000, 10, 5


@dataclass
class Field:
    """Weights of a feature for the label 1 against 0, of label pairs and of the first label."""

    weights: dict[str, float]
    pairs: list[list[float]]
    first: list[float]

    def emissions(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in features]

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not features:
            return []
        score, back = self.emissions(features), []
        best = [self.first[0], self.first[1] + score[0]]
        for s in score[1:]:
            step, came = [], []
            for y in (0, 1):
                a, b = best[0] + self.pairs[0][y], best[1] + self.pairs[1][y]
                came.append(int(b > a))
                step.append(max(a, b) + (s if y else 0.0))
            best = step
            back.append(came)
        y = int(best[1] > best[0])
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]

    def marginals(self, features: list[list[str]]) -> tuple[list[float], list[list[list[float]]]]:
        """P(label 1) of each block and P(label pair) of each two neighbours (forward and backward sums)."""
        score = self.emissions(features)
        n = len(score)
        ahead = [[self.first[0], self.first[1] + score[0]]]
        for s in score[1:]:
            p = ahead[-1]
            ahead.append([_log_add(p[0] + self.pairs[0][y], p[1] + self.pairs[1][y]) + (s if y else 0.0) for y in (0, 1)])
        rest = [[0.0, 0.0] for _ in range(n)]
        for i in range(n - 2, -1, -1):
            s = [0.0, score[i + 1]]
            rest[i] = [_log_add(*(self.pairs[y][z] + s[z] + rest[i + 1][z] for z in (0, 1))) for y in (0, 1)]
        total = _log_add(ahead[-1][0], ahead[-1][1])
        one = [math.exp(ahead[i][1] + rest[i][1] - total) for i in range(n)]
        two = [[[math.exp(ahead[i][y] + self.pairs[y][z] + (score[i + 1] if z else 0.0) + rest[i + 1][z] - total) for z in (0, 1)] for y in (0, 1)] for i in range(n - 1)]
        return one, two


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Stochastic gradient ascent on the log-likelihood, with steps that shrink by feature."""
    field = Field({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    power: dict[str, float] = {}
    order = [p for p in pages if p[0]]
    rng = random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate / (1 + epoch)
        for features, labels in order:
            one, two = field.marginals(features)
            grad: dict[str, float] = {}
            for row, p, y in zip(features, one, labels, strict=True):
                for f in row:
                    grad[f] = grad.get(f, 0.0) + y - p
            for f, g in grad.items():
                power[f] = power.get(f, 1.0) + g * g
                w = field.weights.get(f, 0.0)
                field.weights[f] = w + step * (g / math.sqrt(power[f]) - decay * w)
            for y in (0, 1):
                field.first[y] += 0.1 * step * ((labels[0] == y) - (one[0] if y else 1 - one[0]))
                for z in (0, 1):
                    seen = sum(a == y and b == z for a, b in zip(labels, labels[1:], strict=False))
                    field.pairs[y][z] += 0.1 * step * (seen - sum(t[y][z] for t in two)) / max(1, len(two)) ** 0.5
    return field


def training_pages(first: int, count: int, plain: bool | None = None) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of made pages. Inline parts can join or split blocks; pages where that happens are left out."""
    out = []
    for seed in range(first, first + count):
        page, labels = labelled_page(seed, plain)
        found = blocks(page)
        if len(found) == len(labels):
            out.append(([b.features for b in found], labels))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = PAGES) -> Field:
    return train(training_pages(0, pages))


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    labels = field.decode([b.features for b in found])
    return " ".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, *, html: str = "html", column: str = "text", field: Field | None = None, keep: list[str] | None = None) -> DataFrame:
    """pages with the main text and n_chars, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def columns_of(values: pa.Array) -> list[list]:
        texts = [main_text(t, shared.value) for t in texts_of(values)]
        return [texts, [len(t) for t in texts]]

    return scan_texts(pages, html, [T.StructField(column, T.StringType()), T.StructField("n_chars", T.LongType())], columns_of, keep=keep)
