"""Operator 7: toxicity, cumulative-link ordinal regression.

P(grade <= k) = logistic(cut_k - w.x): one weight vector shared by all ordered cuts.  Features are
sparse indicators: the words of a text (letters, lower case), and beginnings of words that open at
least ``LEAST_RATE`` of its words, once or at least twice (any beginning turns up by chance in
a long text; a rate tells that from use).  Those enter that are more frequent in toxic rows by
``LEAST_Z`` standard errors (and by ``TOP_SHARE`` of what the clearest feature reaches, which keeps
out words that toxic rows share by chance) and ``LEAST_RATIO`` times, and their weights are never
negative, so that no other word can hide them.  Of near copies in the sample one counts.

Labels hold only toxic or not, so the training grades are derived from them: 0 for rows not marked
toxic; rows marked toxic have grade 1, 2 or 3 by how many of their words carry such a feature (1: up
to two, 2: up to five, 3: more).  The output is the expected severity, sum of k * P(grade = k).

A document is rejected if P(grade >= 1) exceeds a threshold calibrated on the sample: at most
``CLEAN_LOSS`` of its rows not marked toxic lie above it, within 0.5 and 0.9.

Edge cases: a null or empty text has no features and gets the severity of the cuts alone; very long
texts are read whole; repeated rows get equal results; of equally likely grades the lowest is given;
without labels of both classes nothing is rejected and severity is 0; an empty table gives an empty
result; an input column named like an output gives way to it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, labelled_sample, release

#: Labelled documents of each class that the model is fitted on, at most (and at most
#: ``common.SAMPLE_BYTES`` of their text).
SAMPLE = 3000
GRADES = 4
GRADE_WORDS = (2, 5)
LEAST_DOCS, LEAST_Z, PREFIXES = 3, 4.5, (3, 4, 5, 6, 7)
LEAST_RATIO, TOP_SHARE = 8.0, 0.25
#: Share of the words of a text that a beginning opens, at least, to count.
LEAST_RATE = 0.01
RIDGE, ROUNDS, CLEAN_LOSS = 2e-3, 300, 0.002

_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def words_of(text: str) -> dict[str, int]:
    """Words, lower case, without marks and digits at their ends, and how often each occurs."""
    out: dict[str, int] = {}
    for w, n in Counter(text.lower().split()).items():
        w = w if w.isalpha() else _STRIP.sub("", w)
        if w:
            out[w] = out.get(w, 0) + n
    return out


def features(words: dict[str, int], total: int | None = None) -> set[str]:
    """Words; beginnings that open enough of the ``total`` words, marked with a dash, and with
    another one if they open two or more."""
    out = set(words)
    least = LEAST_RATE * (sum(words.values()) if total is None else total)
    for size in PREFIXES:
        tally: dict[str, int] = {}
        for w, n in words.items():
            if len(w) > size:
                tally[w[:size]] = tally.get(w[:size], 0) + n
        for start, n in tally.items():
            if n >= least:
                out.add(start + "-")
                if n > 1:
                    out.add(start + "--")
    return out


@dataclass
class Ordinal:
    weights: dict[str, float] = field(default_factory=dict)
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 1.0

    def __post_init__(self):
        self._starts = {f[: min(PREFIXES)] for f in self.weights} | {f.rstrip("-")[: min(PREFIXES)] for f in self.weights}

    def latent(self, text: str) -> float:
        """w.x of a text: the weights of its distinct features."""
        starts, least, get = self._starts, min(PREFIXES), self.weights.get
        words = words_of(text)
        found = {w: n for w, n in words.items() if w[:least] in starts}
        return math.fsum(get(f, 0.0) for f in features(found, sum(words.values()))) if found else 0.0

    def grades(self, latent: np.ndarray) -> np.ndarray:
        """P(grade = k) for each row."""
        if not len(self.cuts):
            return np.eye(1, GRADES).repeat(len(latent), axis=0)
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - latent[:, None], -35, 35)))
        return np.diff(np.hstack([np.zeros((len(latent), 1)), below, np.ones((len(latent), 1))]), axis=1)


def marked_features(rows: list[tuple[dict[str, int], int]]) -> list[str]:
    """Features more frequent in toxic rows, by a two-proportion test."""
    size = [sum(y == c for _, y in rows) for c in (0, 1)]
    tally = [Counter(f for own, y in rows if y == c for f in features(own)) for c in (0, 1)]
    found = []
    for f, n in tally[1].items():
        if n >= LEAST_DOCS:
            share = (n + tally[0][f]) / sum(size)
            error = math.sqrt(share * (1 - share) * (1 / size[0] + 1 / size[1])) or 1e-9
            z = (n / size[1] - tally[0][f] / size[0]) / error
            if n / size[1] >= LEAST_RATIO * (tally[0][f] + 0.5) / size[0]:
                found.append((-z, f))
    found.sort()
    least = max(LEAST_Z, -TOP_SHARE * found[0][0]) if found else 0.0
    return [f for z, f in found if -z >= least]


def without_copies(rows: list[tuple[dict[str, int], int]]) -> list[tuple[dict[str, int], int]]:
    """Rows but for near copies of earlier ones of their class: those that share one of four least
    hashes over their longer words."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    for own, y in rows:
        raw = [w.encode() for w in own if len(w) >= 8]
        least = [(y, k, min(zlib.crc32(w, k) for w in raw)) for k in range(1, 5)] if len(raw) >= 10 else []
        if not any(x in seen for x in least):
            out.append((own, y))
        seen.update(least)
    return out


def grade_rows(rows: list[tuple[dict[str, int], int]], marked: set[str]) -> np.ndarray:
    """Training grades from binary labels, as the module describes."""
    grades = []
    for own, y in rows:
        have = marked & features(own) if y else set()
        starts = {f.rstrip("-") for f in have if f.endswith("-")}
        n = sum(1 for w in own if w in have or any(w[:k] in starts for k in PREFIXES if len(w) > k)) if have else 0
        grades.append(0 if not y else 1 + sum(n > most for most in GRADE_WORDS))
    return np.array(grades)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, classes: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by gradient steps with per-coordinate scaling (ridge on the weights)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows) if len(owner) else np.zeros(0, np.int64)
    w, cuts = np.zeros(size), np.linspace(0.5, 2.5, classes - 1)
    first = [np.zeros(size), np.zeros(classes - 1)]
    second = [np.zeros(size), np.zeros(classes - 1)]
    total = weight.sum()
    every = np.arange(len(rows))
    for step in range(1, ROUNDS + 1):
        latent = np.bincount(owner, w[index], len(rows))
        edge = np.concatenate(([-1e9], cuts, [1e9]))
        f = 1 / (1 + np.exp(-np.clip(edge[None, :] - latent[:, None], -35, 35)))
        high, low = f[every, grades + 1], f[every, grades]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        slope = weight * (d_high - d_low) / p / total
        g_w = np.bincount(index, slope[owner], size) + RIDGE * w / max(1, len(rows)) * 10
        g_c = np.array([
            -(weight * d_high / p)[grades == k].sum() + (weight * d_low / p)[grades == k + 1].sum() for k in range(classes - 1)
        ]) / total
        for k, g in enumerate((g_w, g_c)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            if k:
                # cuts ascend by a little at least
                gap = 1e-3 * np.arange(classes - 1)
                cuts = np.maximum.accumulate(cuts - move - gap) + gap
            else:
                w = np.maximum(w - move, 0.0)
    return w, cuts


def train(rows: list[tuple[dict[str, int], int]]) -> Ordinal:
    """Fit on (words, toxic or not) pairs."""
    y = np.array([label for _, label in rows])
    if not len(y) or y.min() == y.max():
        return Ordinal()
    rows = without_copies(rows)
    y = np.array([label for _, label in rows])
    names = marked_features(rows)
    number = {f: i for i, f in enumerate(names)}
    grades = grade_rows(rows, set(names))
    sets = [features(own) for own, _ in rows]
    index = [np.array(sorted(number[f] for f in s if f in number), dtype=np.int64) for s in sets]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, cuts = fit_ordinal(index, grades, len(names), GRADES, weight)
    model = Ordinal({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, cuts)
    clean = np.sort(1 - model.grades(np.array([w[r].sum() for r, k in zip(index, y, strict=True) if not k]))[:, 0])
    model.threshold = min(0.9, max(0.5, float(clean[min(len(clean) - 1, int(np.ceil((1 - CLEAN_LOSS) * len(clean))) - 1)])))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled documents of each class."""
    rows = labelled_sample(docs, labels, label, sample, None, id_col, text_col)
    found = [(r["id"], r["y"], r["text"] or "") for r in rows.toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[2]))
    model = train([(words_of(t), y) for _, y, t in found])
    del found
    release()
    return model


def apply(docs: DataFrame, model: Ordinal, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``severity`` (expected grade), ``grade`` (likeliest), ``p_toxic`` and ``toxic``
    (boolean: rejected)."""

    def make():
        def run(texts):
            p = model.grades(np.array([model.latent(t) for t in texts], dtype=np.float64))
            toxic = 1 - p[:, 0]
            return [p @ np.arange(GRADES), p.argmax(axis=1), toxic, toxic > model.threshold]

        return run

    fields = [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("p_toxic", T.DoubleType()),
        T.StructField("toxic", T.BooleanType()),
    ]
    return annotate(docs, text_col, make, fields, keep)
