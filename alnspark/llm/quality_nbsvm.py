"""Operator 1: quality classifier, Naive Bayes support vectors.

N-gram indicators of a text are scaled by the log-count ratios of the two classes; a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent, and its margin is
mapped to a probability by a logistic curve.

N-grams: words (lower case), and runs of one to three word shapes.  A shape keeps the kinds of
characters of a word, runs collapsed (``Edge!!`` is ``Aa!``); a word equal to the one before it has
the shape ``=``.

Edge cases: a null or empty text has no n-grams and gets the score of the bias; very long texts are
read whole; repeated rows get equal scores; if only one class is labelled every score is that class
(0 or 1), and without labels 0.5; a score of exactly 0.5 predicts 1; an empty table gives an empty
result; an input column named like an output gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, crc_bucket, labelled_sample, release

#: Labelled documents of each class that the model is fitted on, at most (and at most
#: ``common.SAMPLE_BYTES`` of their text).
SAMPLE = 2500
#: An n-gram counts if this many of the sampled documents hold it.
LEAST_DOCS = 4
#: Smoothing of the ratios, cost of the hinge loss, rounds of descent.
ALPHA, COST, ROUNDS, RANDOM = 1.0, 0.1, 30, 11

_KIND = bytes([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)])


def features(text: str) -> set:
    """The n-gram indicators of a text."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return set()
    kinds = np.frombuffer(raw.translate(_KIND), np.uint8)
    change = np.ones(len(kinds), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    shapes = kinds[change].tobytes().split()
    again = list(map(eq, words, words[1:]))
    if any(again):
        shapes = [shapes[0], *(b"=" if a else s for a, s in zip(again, shapes[1:], strict=True))]
    found = set(raw.lower().split())
    found.update((s,) for s in set(shapes))
    found.update(zip(shapes, shapes[1:], strict=False))
    found.update(zip(shapes, shapes[1:], shapes[2:], strict=False))
    return found


@dataclass
class NbSvm:
    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margin(self, text: str) -> float:
        get = self.weights.get
        return self.bias + math.fsum(get(f, 0.0) for f in features(text))

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(text) + self.shift
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss; rows hold feature numbers, ``values`` the
    value of each feature; the last feature is the bias.  Gives the weights."""
    w = np.zeros(len(values))
    a = np.zeros(len(rows))
    q = np.array([float(values[r] @ values[r]) for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * float(w[r] @ values[r]) - 1
            new = min(max(a[i] - gradient / q[i], 0.0), cost[i]) if q[i] else a[i]
            if new != a[i]:
                w[r] += (new - a[i]) * y[i] * values[r]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, with smoothed targets."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-12
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 1e-3)), float(shift)


def train(examples: list[tuple[set, int]]) -> NbSvm:
    """Fit on (features, label) pairs."""
    y = np.array([label for _, label in examples])
    if not len(y):
        return NbSvm(constant=0.5)
    if y.min() == y.max():
        return NbSvm(constant=float(y[0]))
    tally = Counter(f for own, _ in examples for f in own)
    names = [f for f, n in sorted(tally.items(), key=lambda x: (-x[1], repr(x[0]))) if n >= LEAST_DOCS]
    number = {f: i for i, f in enumerate(names)}
    rows = [np.array(sorted(number[f] for f in own if f in number) + [len(names)], dtype=np.int64) for own, _ in examples]
    count = [ALPHA + np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c]), minlength=len(names) + 1) for c in (0, 1)]
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[-1] = 1.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = descend(rows, ratio, np.where(y == 1, 1.0, -1.0), COST * weight, ROUNDS, RANDOM)
    product = w * ratio
    margin = np.array([product[r].sum() for r in rows])
    slope, shift = logistic_curve(margin, y)
    kept = {f: float(product[i]) for f, i in number.items() if product[i] != 0.0}
    return NbSvm(kept, float(product[-1]), slope, shift)


def held_out(id_col: str = "doc_id"):
    """True for documents whose labels are never learned from."""
    return crc_bucket(id_col, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE, exclude=held_out) -> NbSvm:
    """Fit on at most ``sample`` labelled documents of each class, without those ``exclude`` names."""
    rows = labelled_sample(docs, labels, label, sample, exclude, id_col, text_col)
    found = [(r["id"], r["y"], r["text"] or "") for r in rows.toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[2]))
    model = train([(features(t), y) for _, y, t in found])
    del found
    release()
    return model


def score(docs: DataFrame, model: NbSvm, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1, higher: the positive class is likelier) and ``predicted``."""

    def make():
        def run(texts):
            scores = [model.score(t) for t in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return annotate(docs, text_col, make, fields, keep)
