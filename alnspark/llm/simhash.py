"""Operator 5: SimHash near-duplicates.

Fingerprints: 64-bit SimHash of word shingles (XXH64).  Candidate search: an inverted index from
byte positions and byte values to fingerprints, with count filtering.  Two fingerprints that differ
in at most ``d`` bits agree in at least ``8 - d`` of their 8 bytes.  Posting lists of single bytes
would hold 1/256 of the corpus, so lists are kept for sets of ``8 - d`` positions at once: a pair
shares such a list exactly if its tally of equal positional bytes reaches the minimum.  Of the pairs
that meet in a list the tally is taken, those below the minimum (lists meet by a hash) are dropped,
and the rest are verified bit by bit.

Only distinct fingerprints enter the index, so any number of exact copies costs one entry.  Within
a posting list only a spanning forest of the links is written, never all pairs.  Lists longer than
``LIST_BOUND`` are not held in memory: their fingerprints are linked through the points within
``d / 2`` bits, which is exact as well and linear in the list.  Lists that a sample shows to be that
long are not even dealt to a task; the sample decides about cost only.

Components come from alternating star contraction over written tables; nothing grows on the driver.
A fingerprint, node or component that holds a large share of all rows is looked up by broadcast
(their number is bounded), so that its rows stay where they are.

Edge cases: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all; very long texts are hashed in blocks; a
bit set in exactly half of the hashes is 0; repeated rows share a component; null ids take part, but
are never the smallest id unless all ids of a component are null; an empty table gives an empty
result; only the id and text columns are read, so others cannot clash with the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, fresh, lookup, materialize
from .components import components

WORDS, BITS, SEED = 4, 4, 42
#: Longest posting list that one task links in memory (8 bytes an entry).
LIST_BOUND = 1 << 15
#: Fingerprints by whose lists long ones are told beforehand, and the least entries there.
SAMPLE, SEEN = 1 << 16, 8
#: Shingles hashed at once; bounds memory for very long texts.
BLOCK = 1 << 15

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of the word shingles of a text, in order, at most ``BLOCK`` at once."""
    flat = b" ".join(text.encode().translate(_LOWER).split())
    if not flat:
        return
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = len(blanks) + 1
    if n <= words:
        yield np.array([xxhash.xxh64_intdigest(flat, seed)], "<u8")
        return
    starts = np.concatenate(([0], blanks + 1))[: n - words + 1]
    ends = np.concatenate((blanks, [len(flat)]))[words - 1 :]
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        shingles = [flat[s:e] for s, e in pairs]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", len(shingles))


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingle hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words, seed):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    set_bits = np.packbits(2 * ones > n, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS, seed: int = SEED, keep=None) -> DataFrame:
    """Append ``fp``: the fingerprint as a signed 64-bit number."""

    def make():
        def run(texts):
            values = np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64)
            return [values.view(np.int64)]

        return run

    return annotate(docs, text_col, make, [T.StructField("fp", T.LongType())], keep)


def tally(difference: np.ndarray) -> np.ndarray:
    """How many positional bytes are equal, from the exclusive or of two fingerprints."""
    bits = difference | difference >> np.uint64(4)
    bits |= bits >> np.uint64(2)
    bits |= bits >> np.uint64(1)
    return 8 - np.bitwise_count(bits & np.uint64(0x0101010101010101))


def linked(difference: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs are links, from their exclusive or: those whose tally reaches the minimum that
    ``bits`` guarantees, verified bit by bit."""
    return (tally(difference) >= 8 - bits) & (np.bitwise_count(difference) <= bits)


def _links(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``values`` that differ in at most ``bits`` bits.

    Rounds of pivots: each takes what lies in its range out of the pool; pivots of one round are
    then searched from the members taken, until no member finds anything outside its component.
    """
    left, right = [], []
    pool = values
    while len(pool) > 1:
        frontier, pool = pool[:1], pool[1:]
        while len(frontier) and len(pool):
            near_of = np.full(len(pool), -1)
            step = max(1, (1 << 22) // len(pool))
            for at in range(0, len(frontier), step):
                part = frontier[at : at + step]
                near = linked(part[:, None] ^ pool[None, :], bits)
                hit = near.any(axis=0) & (near_of < 0)
                near_of[hit] = at + near[:, hit].argmax(axis=0)
            taken = near_of >= 0
            left.append(frontier[near_of[taken]])
            right.append(pool[taken])
            frontier, pool = pool[taken], pool[~taken]
    if not left:
        return values[:0], values[:0]
    return np.concatenate(left), np.concatenate(right)


def _posting_links(bits: int, bound: int):
    """Reads (key, fp) sorted by key; gives links (a, b), and (fp, null) for lists over ``bound``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(a, b):
        none = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, long = None, [], 0, False
        for batch in batches:
            keys = np.asarray(batch.column(0))
            fps = np.asarray(batch.column(1)).view(np.uint64)
            if not len(keys):
                continue
            cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            lengths = np.diff(cut)
            last = len(lengths) - 1
            a_out, b_out = [], []
            # runs of two inside the batch, all at once
            inner = np.arange(len(lengths))
            two = np.flatnonzero((lengths == 2) & (inner > 0) & (inner < last))
            if len(two):
                a, b = fps[cut[two]], fps[cut[two] + 1]
                near = linked(a ^ b, bits)
                a_out.append(a[near])
                b_out.append(b[near])
            for i in np.flatnonzero((lengths > 2) | (inner == 0) | (inner == last)):
                part = fps[cut[i] : cut[i + 1]]
                if keys[cut[i]] != key or key is None:
                    if count > 1 and not long:
                        a, b = _links(np.concatenate(held), bits)
                        a_out.append(a)
                        b_out.append(b)
                    key, held, count, long = keys[cut[i]], [], 0, False
                count += len(part)
                if long:
                    yield batch_of(part, None)
                elif count > bound:
                    long = True
                    yield batch_of(np.concatenate([*held, part]), None)
                    held = []
                else:
                    held.append(part.copy())
            if a_out and sum(map(len, a_out)):
                yield batch_of(np.concatenate(a_out), np.concatenate(b_out))
        if count > 1 and not long:
            a, b = _links(np.concatenate(held), bits)
            if len(a):
                yield batch_of(a, b)

    return run


def _ball_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links between fingerprints that share a point within ``bits / 2`` bits of both: exactly those
    within ``bits`` bits, for even ``bits``; linear in the number of fingerprints."""
    masks = [sum(1 << b for b in c) for k in range(bits // 2 + 1) for c in combinations(range(64), k)]
    points = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    best = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return points.join(best, "point").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, bits: int = BITS, bound: int = LIST_BOUND) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within ``bits`` bits."""
    if bits not in (2, 4, 6):
        raise ValueError("bits must be 2, 4 or 6")
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), 8 - bits)]
    # a key names its positions and holds their bytes; hashed to one number, unequal lists that
    # happen to share a key only add candidates, which the tally drops
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]

    def indexed(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(*keys)).alias("key"), "fp")

    index, long = indexed(distinct), None
    n = distinct.count()
    if n > bound:
        step = max(1, n // SAMPLE)
        some = indexed(distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0))
        least = max(SEEN, bound // step + 1)
        hot = materialize(some.groupBy("key").count().filter(F.col("count") >= least).select("key"), "hot-keys")
        if not hot.isEmpty():  # at most positions x SAMPLE / SEEN numbers
            long = index.join(F.broadcast(hot), "key", "left_semi").select("fp").distinct()
            index = index.join(F.broadcast(hot), "key", "left_anti")
    index = index.repartition("key").sortWithinPartitions("key")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    found = materialize(index.mapInArrow(_posting_links(bits, bound), schema), "links")
    pairs = found.filter("b IS NOT NULL").distinct()
    rest = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    long = materialize(rest if long is None else rest.unionByName(long).distinct(), "long")
    return pairs if long.isEmpty() else pairs.unionByName(_ball_links(long, bits))


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, seed: int) -> DataFrame:
    """(__id, fp, label, component_id) of every row; label is the smallest fingerprint reachable."""
    rows = docs.select(column(id_col).alias("__id"), column(text_col).alias("text"))
    marked = materialize(fingerprints(rows, "text", words, seed, keep=["__id"]), "fingerprints")
    owners = marked.groupBy("fp").agg(F.min("__id").alias("first"), F.count("*").alias("copies"))
    owners = materialize(owners, "owners")
    return labels_of(marked, owners, links(owners.select("fp"), bits))


def labels_of(marked: DataFrame, owners: DataFrame, linked: DataFrame) -> DataFrame:
    """(__id, fp, label, component_id) of every row of ``marked`` (__id, fp), by the links between
    its fingerprints; ``owners`` has the smallest id and the number of rows of each."""
    member = components(linked)
    labelled = owners.join(member, owners["fp"] == member["node"], "left").select(
        "fp", "first", "copies", F.coalesce("label", "fp").alias("label")
    )
    labelled = materialize(labelled, "labels")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    smallest = materialize(smallest, "components")
    named = lookup(labelled.select("fp", "copies", "label"), smallest, "label", "members", owners.count())
    return lookup(marked, materialize(named, "named"), "fp", "copies", marked.count())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    bits: int = BITS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    return _labelled(docs, id_col, text_col, words, bits, seed).select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    bits: int = BITS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with one row of each component: one with its smallest id.

    Where that id is repeated, one of its rows stays; a component without ids keeps one row too.
    """
    labelled = _labelled(docs, id_col, text_col, words, bits, seed)
    return first_of(docs, labelled, id_col, text_col, lambda rows, keep: fingerprints(rows, "text", words, seed, keep))


def first_of(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, mark) -> DataFrame:
    """``docs`` with one row of each label of ``labelled``; ``mark(rows, keep)`` gives the
    fingerprints of rows whose id is repeated."""
    marked = materialize(labelled, "labelled")
    first = marked.filter(F.col("__id").eqNullSafe(F.col("component_id")))
    first = materialize(first.groupBy("label").agg(F.min("__id").alias("__id"), F.min("fp").alias("fp")), "first")
    repeated = materialize(marked.groupBy("__id").count().filter("count > 1 OR __id IS NULL").select("__id"), "repeated")
    wanted = fresh(docs, "__wanted")
    by_id = column(id_col).eqNullSafe(F.col(wanted))
    if repeated.isEmpty():
        return docs.join(first.select(F.col("__id").alias(wanted)), by_id, "left_semi")
    plain = first.join(repeated, "__id", "left_anti").filter("__id IS NOT NULL")
    out = docs.join(plain.select(F.col("__id").alias(wanted)), by_id, "left_semi")
    rows = docs.select(
        column(id_col).alias("own"), column(text_col).alias("text"),
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
    )
    rows = rows.join(repeated, F.col("own").eqNullSafe(F.col("__id")), "left_semi")
    rows = mark(rows, ["own", "row"])
    again = first.join(repeated.withColumnRenamed("__id", "r"), F.col("__id").eqNullSafe(F.col("r")), "left_semi")
    again = again.select(F.col("__id"), F.col("fp").alias("f"), "label")
    rows = rows.join(again, F.col("own").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("f")))
    # of several rows the first in the order of all columns that have one
    ordered = [c.name for c in docs.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    least = F.min_by("row", F.struct(*[F.col("row").getField(c) for c in ordered]))
    return out.unionByName(rows.groupBy("label").agg(least.alias("row")).select("row.*"))
