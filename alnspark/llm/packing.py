"""Operator 4: packing examples into training sequences.

Vector bin packing: every example is a vector (tokens, one segment, loss-bearing tokens), every
sequence has a limit on each.  The dot-product heuristic fills one sequence at a time: among the
examples that still fit it takes the one whose vector has the largest dot product with what is left,
all scaled by the limits.

Each partition is packed on its own in bounded blocks, so there is no shuffle and a lost task is
simply run again.  Sequence ids are the partition number times 2**40 plus a counter.

``pack_texts`` may cut: whole sequences are cut off long documents, and when no remainder fits a
gap, the best one is cut to fill it.  What the last sequences of a partition leave over is cut at
powers of two, so that nothing is padded.  Every token of a piece but its first bears loss, so a limit
on those below the limit on tokens makes pieces shorter and sequences of several pieces fuller.
``pack_examples`` never cuts.

Edge cases: a null or empty text is the terminator alone; a very long text is cut into many whole
sequences; of equally good examples the first that came is taken; repeated rows are packed
separately; a null id stays null; an example larger than a limit by itself raises ``ValueError`` in
``pack_examples``; an empty table gives an empty result.  ``pack_texts`` reads the id and text columns
only; in ``pack_examples`` a column named like an output gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WORDS_KEPT, PieceEncoder, default_path
from .common import SLICE, by_place, release, texts_of

#: Examples held for one round of packing, and how many are kept back for the next round.
BLOCK, KEPT_BACK = 1024, 128
TAKEN = 1e18


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1023

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class Packer:
    """Fills sequences from a pool of examples by the dot-product heuristic."""

    def __init__(self, limits: Limits):
        self.limit = limits.vector()
        self.size = np.zeros((3, 0))
        self.items: list = []

    def add(self, items: list, sizes: list[tuple[int, int, int]]) -> None:
        self.items += items
        self.size = np.hstack([self.size, np.asarray(sizes, dtype=np.float64).reshape(-1, 3).T])

    def sequences(self, keep: int, cut=None) -> Iterator[list]:
        """Sequences of items, until at most ``keep`` items are left.

        ``cut(item, tokens)`` parts an item into two, each with its vector; None forbids it.
        """
        tokens, segments, loss = self.size
        weight = 1 / self.limit**2
        left = len(self.items)
        while left > keep:
            room, own = self.limit.copy(), []
            while left:
                # an item that was taken counts as too large
                fits = (tokens <= room[0]) & (segments <= room[1]) & (loss <= room[2])
                scale = room * weight
                product = np.where(fits, tokens * scale[0] + segments * scale[1] + loss * scale[2], -1.0)
                best = int(product.argmax())
                if not fits[best]:
                    break
                own.append(self.items[best])
                room -= self.size[:, best]
                tokens[best] = TAKEN
                left -= 1
            if cut and left and room[0] >= 1 and room[1] >= 1:
                best = int(np.where(tokens < TAKEN, tokens, -1.0).argmax())
                # a piece of n tokens bears n - 1 losses; nothing fits, so the longest is longer
                (head, _), (tail, rest) = cut(self.items[best], int(min(room[0], room[2] + 1)))
                own.append(head)
                self.items[best] = tail
                self.size[:, best] = rest
            yield own
        alive = tokens < TAKEN
        self.items = [x for x, a in zip(self.items, alive.tolist(), strict=True) if a]
        self.size = np.ascontiguousarray(self.size[:, alive])


def powers(total: int) -> list[int]:
    """``total`` as a sum of falling powers of two."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


@dataclass(frozen=True)
class Piece:
    """Part of a document: packed ids, where they start, and whose they are."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def vector(self) -> tuple[int, int, int]:
        # the first token of a piece has nothing before it to be predicted from
        return self.length, 1, self.length - 1

    def cut(self, tokens: int):
        head = Piece(self.doc, self.start, self.ids[: 4 * tokens], self.doc_tokens)
        tail = Piece(self.doc, self.start + tokens, self.ids[4 * tokens :], self.doc_tokens)
        return (head, head.vector()), (tail, tail.vector())


def without_padding(pieces: list[Piece], full: int) -> list[list[Piece]]:
    """A sequence that is neither full nor a power of two, recut at powers of two."""
    used = sum(p.length for p in pieces)
    if used == full:
        return [pieces]
    out, queue = [], list(pieces)
    for room in powers(used):
        own: list[Piece] = []
        while room:
            piece = queue.pop(0)
            if piece.length > room:
                (piece, _), (rest, _) = piece.cut(room)
                queue.insert(0, rest)
            own.append(piece)
            room -= piece.length
        out.append(own)
    return out


def pack_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limits: Limits = Limits(),
    terminator: int = 0,
    with_ids: bool = False,
    words_kept: int = WORDS_KEPT,
) -> DataFrame:
    """Encode whole texts, end each with ``terminator`` and pack them; one row per piece.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and, if asked, ``ids``.  Only the id column is carried along.  ``words_kept``: encoded
    words (and half as many pieces) that a worker keeps, a matter of memory against time alone.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in names]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else [])
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    full = limits.tokens
    # a whole sequence of one piece: all tokens, or the largest power of two that the loss limit lets through
    longest = full if limits.loss >= full - 1 else powers(limits.loss + 1)[0]
    end = int(terminator).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path or default_path("byte_bpe_50k.json"), words_kept, words_kept // 2)
        packer = Packer(limits)
        base, made = TaskContext.get().partitionId() << 40, 0
        columns: list[list] = [[] for _ in schema]

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for p in pieces:
                row = [p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, base + made, offset]
                if with_ids:
                    row.append(p.ids)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += p.length
            made += 1

        def flush():
            arrays = [pa.array(c, f.type) for c, f in zip(columns[: 1 + len(names)], arrow, strict=False)]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(columns[-1]), "<i4"))
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), values).cast(arrow[-1].type))
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rest = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts_of(part.column(1))), strict=True):
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % longest
                    for start in range(0, whole, longest):
                        emit([Piece(doc, start, ids[4 * start : 4 * (start + longest)], n)])
                    if n > whole:
                        rest.append(Piece(doc, whole, ids[4 * whole :], n))
                packer.add(rest, [p.vector() for p in rest])
                if len(packer.items) >= BLOCK:
                    for sequence in packer.sequences(KEPT_BACK, Piece.cut):
                        for recut in without_padding(sequence, full):
                            emit(recut)
                if columns[0]:
                    yield flush()
        for sequence in packer.sequences(0, Piece.cut):
            for recut in without_padding(sequence, full):
                emit(recut)
        if columns[0]:
            yield flush()
        del encoder, packer
        release()

    return by_place(docs, [id_col, text_col]).mapInArrow(run, schema)


def pack_examples(
    examples: DataFrame, tokens_col: str, loss_col: str, limits: Limits = Limits()
) -> DataFrame:
    """Place whole examples (instruction data) by their counts; appends ``sequence_id``, ``slot``
    (place within the sequence) and ``offset`` (tokens before it there).  Null counts are zero."""
    new = ["sequence_id", "slot", "offset"]
    kept = [c for c in examples.columns if c.lower() not in new]
    schema = T.StructType([examples.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in new])
    counts = [F.coalesce(F.col(f"c{i}").cast("long"), F.lit(0)) for i in (0, 1)]
    source = by_place(examples, [tokens_col, loss_col, *kept])
    source = source.select(counts[0].alias("c0"), counts[1].alias("c1"), *source.columns[2:])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits)
        base, made = TaskContext.get().partitionId() << 40, 0

        def rows(keep: int):
            nonlocal made
            for sequence in packer.sequences(keep):
                offset = 0
                for slot, (row, tokens) in enumerate(sequence):
                    ids = [pa.array([v], pa.int64()) for v in (base + made, slot, offset)]
                    yield pa.RecordBatch.from_arrays([*row.columns[2:], *ids], names=names)
                    offset += tokens
                made += 1

        def joined(keep: int):
            if got := list(rows(keep)):
                yield from pa.Table.from_batches(got).combine_chunks().to_batches()

        for batch in batches:
            tokens, loss = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for t, x in zip(tokens, loss, strict=True):
                if t > limits.tokens or x > limits.loss:
                    raise ValueError(f"an example of {t} tokens, {x} with loss, exceeds the limits")
            packer.add(
                [(batch.slice(i, 1), t) for i, t in enumerate(tokens)],
                [(t, 1, x) for t, x in zip(tokens, loss, strict=True)],
            )
            if len(packer.items) >= BLOCK:
                yield from joined(KEPT_BACK)
        yield from joined(0)

    return source.mapInArrow(run, schema)
