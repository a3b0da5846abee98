"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1.  A letter trigram is bound into one vector: the
product of its letters' vectors, the first permuted twice and the second once (a permutation is a
rotation by one place).  The vectors of all trigrams of a text are bundled by adding them up, and so
are the texts of a language, each scaled to length one: its prototype.  A document gets the language whose prototype has the largest
cosine with its own vector.

Letters (the characters that Unicode calls letters, so no digits, numbers or marks of any script) are
folded to lower case, everything between them counts as one blank.

Edge cases: a text that is null or holds no letter is ``und`` with score 0; very long texts are bundled
in parts; repeated rows get equal results; with no language to learn from, every text is ``und``; ties
go to the language first in order; an empty table gives an empty result; an input column named like
an output gives way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, crc_bucket

#: Places of a vector, rows of the letter table (letters beyond it share rows by a hash).
DIMENSIONS, LETTERS, RANDOM = 512, 2048, 5
#: Documents of each language that its prototype is bundled from, about; picked by a hash of the id.
SAMPLE = 1500
#: Trigram vectors kept bound by a worker, and trigrams bundled at once; bounds memory.
KNOWN, PART = 16_000, 4096
#: Languages that are learned, at most, commonest first: bounds the model and what the driver collects.
MOST_LANGUAGES = 1024

_GAPS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """The letters of a text, lower case, with one blank for whatever stands between them."""
    folded = _GAPS.sub(" ", text.lower())
    if not folded.isascii():
        # some numbers of other scripts count as parts of words, but are no letters
        odd = [c for c in set(folded) if c != " " and not c.isalpha()]
        if odd:
            folded = re.sub(" +", " ", folded.translate(dict.fromkeys(map(ord, odd), " ")))
    return folded.strip()


def letter_table(dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """The letter vectors as they stand in the last, middle and first place of a trigram."""
    rng = np.random.default_rng(RANDOM)
    base = rng.integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * 2 - 1
    return [np.roll(base, k, axis=1).astype(np.float32) for k in range(3)]


class Bundler:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.table = letter_table(dimensions)
        self.dimensions = dimensions
        self.known: dict[int, int] = {}
        self.rows = np.empty((KNOWN + PART, dimensions), np.float32)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text as numbers, and how often each stands in it."""
        folded = letters_of(text)
        if not folded:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.frombuffer(f" {folded} ".encode("utf-32-le"), "<u4").astype(np.int64)
        code = np.where(code < 1024, code, 1024 + code * 2654435761 % (LETTERS - 1024))
        if len(code) < 3:
            code = np.concatenate([code, np.full(3 - len(code), 32)])
        return np.unique((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], return_counts=True)

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the trigrams' vectors, bound when first met."""
        new = np.array([g for g in grams.tolist() if g not in self.known], dtype=np.int64)
        if len(new):
            last, middle, first = self.table
            made = first[new // LETTERS**2] * middle[new // LETTERS % LETTERS] * last[new % LETTERS]
            at = len(self.known)
            self.known.update(zip(new.tolist(), range(at, at + len(new)), strict=True))
            self.rows[at : at + len(new)] = made
        return np.fromiter(map(self.known.__getitem__, grams.tolist()), np.int64, len(grams))

    def bundle(self, text: str) -> np.ndarray | None:
        """The vector of a text; None if it holds no letter."""
        grams, times = self.trigrams(text)
        if not len(grams):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(grams), PART):
            part = grams[at : at + PART]
            if len(self.known) > KNOWN:  # bounds memory; vectors are bound anew when met again
                self.known.clear()
            out += times[at : at + PART].astype(np.float32) @ self.rows[self._places(part)]
        return out


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray

    def predict(self, bundles: list[np.ndarray | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for b in bundles:
            if b is None or not self.names or not (size := float(np.linalg.norm(b))):
                langs.append("und")
                scores.append(0.0)
                continue
            cosine = self.vectors @ b / size
            best = int(cosine.argmax())
            langs.append(self.names[best])
            scores.append(float(min(max(cosine[best], 0.0), 1.0)))
        return langs, scores


def held_out(id_col: str = "doc_id"):
    """True for documents that are never learned from."""
    return crc_bucket(id_col, 5) == 0


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE, exclude=held_out) -> Profiles:
    """Bundle prototypes from about ``sample`` documents of each language.

    The share of each language's documents that is used follows from its count, so rare languages
    are used whole; documents are chosen by a hash of their id.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    rows = rows.filter(~exclude("id"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in common.collect()}
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    rates = spark.createDataFrame(
        [(lang, int(min(1.0, sample / n) * (1 << 30))) for lang, n in sorted(counts.items())], "lang string, most long"
    )
    picked = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("most"))

    def make():
        bundler = Bundler()

        def run(texts):
            out = []
            for b in map(bundler.bundle, texts):
                out.append(None if b is None else (b / (np.linalg.norm(b) or 1.0)).astype(np.float64))
            return [out]

        return run

    vectors = annotate(picked, "text", make, [T.StructField("v", T.ArrayType(T.DoubleType(), False))], keep=["lang"])
    total: dict[str, np.ndarray] = {}
    # rounding makes sums independent of the order in which partitions arrive
    sums = vectors.filter("v IS NOT NULL").select("lang", F.posexplode("v").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    for r in sums.collect():
        total.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    names = sorted(total)
    unit = [total[n] / (np.linalg.norm(total[n]) or 1.0) for n in names]
    return Profiles(names, np.array(unit, dtype=np.float32).reshape(len(names), DIMENSIONS))


def predict(docs: DataFrame, model: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score`` (the cosine, 0 at least)."""

    def make():
        bundler = Bundler()
        return lambda texts: model.predict([bundler.bundle(t) for t in texts])

    return annotate(docs, text_col, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
