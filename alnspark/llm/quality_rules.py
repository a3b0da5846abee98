"""Operator 10: quality rules with an isolation forest.

Exact rule statistics per document, base rules on them, and an isolation forest for the rest:
random trees part a sample of statistics at random places, and documents that are parted from the
others early (short paths) are anomalies.  Thresholds are calibrated on all labelled rows: the forest reads
by how much each rate exceeds the level that all but ``CLEAN_LOSS`` of the good rows stay under, and
the threshold on its score keeps all but as many of them.  Each tree draws its rows from all labelled rows.

Rates are read in steps, so all labelled rows come down to a tally of few different rates; the driver
holds that tally (at most ``(STEPS + 1) ** 6`` entries a class) and no text.

Words are runs of characters other than blank and \\t \\n \\v \\f \\r.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; very long texts
are counted whole; repeated rows get equal results; a score equal to the threshold is kept; without
usable labels only the base rules decide; an empty table gives an empty result; an input column named
like an output gives way to it.  Ids labelled more than once count with their largest label; labels other
than 0 and 1 are ignored.  Of an id that stands in several rows the shortest text counts, of equally long
ones that with the least hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column

MIN_WORDS, REPEAT_PERCENT = 50, 50
TREES, TREE_ROWS, CLEAN_LOSS, RANDOM = 100, 256, 0.002, 7
BAD_SHARE = 0.1
#: Rates are read in so many steps: small differences between ordinary documents are no anomalies.
STEPS = 8
#: Counted as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_FOLD = bytes([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rates that the forest reads.
RATES = 6


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    tally = Counter(windows)
    hit = np.zeros(len(words), dtype=bool)
    twice = np.fromiter((tally[w] > 1 for w in windows), bool, len(windows))
    for shift in range(3):
        hit[shift : shift + len(windows)] |= twice
    return int(hit.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The exact counts (``COUNTS``), and the rates that the forest reads."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = sum(text.count(c) for c in _BLANKS)
    chars = len(text) - blanks
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    kinds = np.bincount(np.frombuffer(raw.translate(_FOLD), np.uint8), minlength=128)
    upper, letters = int(kinds[65]), int(kinds[65] + kinds[97])
    of_chars, of_words = max(chars, 1), max(n, 1)
    rates = [
        symbols / of_words,
        2 * repeated / of_words,
        2 * dup_lines / max(len(lines), 1),
        2 * upper / max(letters, 1),
        int(kinds[33]) / of_words,
        4 * int(kinds[48]) / of_chars,
    ]
    rates = [min(int(STEPS * r), STEPS) / STEPS for r in rates]
    return [n, chars, symbols, dup_lines, repeated], rates


def path_norm(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as flat arrays; a leaf has feature -1 and holds the expected path length to its rows."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = RANDOM, total: int | None = None,
            draw: Callable[[np.random.Generator, int], np.ndarray] | None = None) -> IsolationForest:
        """Each tree parts ``rows`` rows of ``x``.  If ``x`` holds equal rows once, ``total`` says how many
        there are, and ``draw`` draws the places in ``x`` of so many of them."""
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x) if total is None else total)
        draw = draw or (lambda rng, n: rng.choice(len(x), n, replace=False))
        depth = int(np.ceil(np.log2(max(rows, 2))))
        feature, split, child, path, roots = [], [], [], [], []
        for _ in range(trees):
            roots.append(len(feature))
            todo = [(draw(rng, rows), 0, None)]
            while todo:
                own, at, parent = todo.pop()
                node = len(feature)
                if parent is not None:
                    child[parent[0]][parent[1]] = node
                low, high = x[own].min(axis=0), x[own].max(axis=0)
                open_ = np.flatnonzero(high > low)
                if at >= depth or len(own) < 2 or not len(open_):
                    feature.append(-1)
                    split.append(0.0)
                    path.append(at + path_norm(len(own)))
                    child.append([node, node])
                    continue
                f = int(rng.choice(open_))
                s = float(rng.uniform(low[f], high[f]))
                feature.append(f)
                split.append(s)
                path.append(0.0)
                child.append([node, node])
                right = x[own, f] > s
                todo += [(own[right], at + 1, (node, 1)), (own[~right], at + 1, (node, 0))]
        return cls(*map(np.array, (feature, split, child, path, roots)), path_norm(rows) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, near 1 for rows parted early and below 0.5 for ordinary ones."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                if (f < 0).all():
                    break
                side = (x[every, np.maximum(f, 0)] > self.split[node]).astype(int)
                node = self.child[node, side]
            total += self.path[node]
        return 2.0 ** (-total / (len(self.roots) * self.norm))


@dataclass
class RuleModel:
    """``level``: the rates that all but a few good rows stay under; the forest reads what exceeds
    them."""

    forest: IsolationForest | None
    threshold: float
    level: np.ndarray | None = None

    def score(self, rates: np.ndarray) -> np.ndarray:
        return self.forest.score(np.maximum(rates - self.level, 0.0))


def to_code(rates: list[float]) -> int:
    """Rates in steps as the digits of one number."""
    code = 0
    for r in reversed(rates):
        code = code * (STEPS + 1) + round(STEPS * r)
    return code


def from_codes(codes: np.ndarray) -> np.ndarray:
    """The rates of each number that :func:`to_code` gave."""
    return codes[:, None] // (STEPS + 1) ** np.arange(RATES) % (STEPS + 1) / STEPS


def tally(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, code, count) over all labelled documents with enough words, each id once: how many rows of
    each label have the rates of a code.  Only counts and codes are shuffled, no text."""
    marked = labels.select(column(id_col).alias("__id"), column(label).cast("int").alias("y"))
    marked = marked.filter(F.col("__id").isNotNull() & F.col("y").isin(0, 1)).groupBy("__id").agg(F.max("y").alias("y"))
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.filter(F.col("id").isNotNull()).withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})

    def make():
        def run(texts):
            found = [statistics(t) for t in texts]
            return [[c[0] for c, _ in found], [to_code(r) for _, r in found]]

        return run

    fields = [T.StructField("n", T.LongType()), T.StructField("code", T.LongType())]
    rows = annotate(texts, "text", make, fields, keep=["id", "size", "hash"])
    rows = rows.groupBy("id").agg(F.min(F.struct("size", "hash", "n", "code")).alias("t"))
    rows = rows.join(marked, F.col("id") == F.col("__id")).filter(F.col("t.n") >= MIN_WORDS)
    return rows.groupBy("y", F.col("t.code").alias("code")).count()


def _below(values: np.ndarray, counts: np.ndarray, share: float):
    """The least of the values, each there so many times, that this share of all do not exceed."""
    order = np.argsort(values)
    reached = np.cumsum(counts[order])
    return values[order[np.searchsorted(reached, np.ceil(share * reached[-1]))]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        clean_loss: float = CLEAN_LOSS) -> RuleModel:
    """Fit the forest on all labelled rows, bad ones drawn as a share of ``BAD_SHARE`` (as far as there
    are such), and calibrate its threshold: at most ``clean_loss`` of all good rows with enough words lie
    above it."""
    found = tally(docs, labels, label, id_col, text_col).toArrow()
    y, codes, counts = (np.asarray(found.column(c).combine_chunks()) for c in ("y", "code", "count"))
    order = np.lexsort((codes, -y))  # good ones first
    y, counts, rates = y[order], counts[order], from_codes(codes[order])
    of_good = int((y == 1).sum())
    good, ends = rates[:of_good], (np.cumsum(counts[:of_good]), np.cumsum(counts[of_good:]))
    n_good, n_bad = (int(e[-1]) if len(e) else 0 for e in ends)
    if n_good < 2:
        return RuleModel(None, 1.0)
    share = min(n_bad, int(n_good * BAD_SHARE / (1 - BAD_SHARE)))

    def draw(rng: np.random.Generator, n: int) -> np.ndarray:
        """Rows of all good ones and as many places for bad ones as make their share; all bad ones may
        come to such a place."""
        at = rng.choice(n_good + share, n, replace=False)
        own = at[at < n_good]
        bad = rng.choice(n_bad, n - len(own), replace=False)
        return np.concatenate((np.searchsorted(ends[0], own, "right"), of_good + np.searchsorted(ends[1], bad, "right")))

    level = np.array([_below(good[:, f], counts[:of_good], 1 - clean_loss) for f in range(RATES)])
    forest = IsolationForest.fit(np.maximum(rates - level, 0.0), total=n_good + share, draw=draw)
    model = RuleModel(forest, 1.0, level)
    model.threshold = float(_below(model.score(good), counts[:of_good], 1 - clean_loss))
    return model


def apply(docs: DataFrame, model: RuleModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the counts, ``base_failed``, ``anomaly`` (the forest's score, null without a forest)
    and ``kept``."""

    def make():
        def run(texts):
            found = [statistics(t) for t in texts]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            rates = np.array([r for _, r in found]).reshape(len(found), -1)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            score = model.score(rates) if model.forest else [None] * len(found)
            kept = ~failed & ~(score > model.threshold if model.forest else np.zeros(len(found), bool))
            return [*counts.T, failed, score, kept]

        return run

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return annotate(docs, text_col, make, fields, keep)
