"""Operator 2: byte-level BPE encoding and decoding.

The ``tokenizers`` library encodes over Arrow batches.  Texts are first cut at places where the
library's own splitting pattern always cuts, so each distinct piece is encoded once per worker and
reused; the ids equal those of encoding the whole text.  A mapping from bytes to characters gives
character offsets, also for tokens that hold only part of a character.  Decoding looks ids up in
the reversed byte table and joins raw bytes, so characters split over tokens come back whole.

Edge cases: a null or empty text has no tokens and decodes to the empty byte string; very long texts are
encoded whole; special-token strings inside a text are ordinary text; unknown ids raise ``ValueError``
on decoding; repeated rows get equal results; of merges of equal rank the library takes the first; an
empty table gives an empty result; an input column named like an output gives way to it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate

#: Words and pieces kept per worker before the older half is let go, and the longest of them (in
#: characters) that are kept at all.  An entry so takes at most about 850 bytes, 250 as a rule, and
#: memory is bounded; results never change.
WORDS_KEPT, PIECES_KEPT, LONGEST_KEPT = 300_000, 150_000, 32

# White space as the splitting pattern sees it (Unicode White_Space).
_WS = "\\t-\\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r'.,;:!?#$%&*|()"\]\[/+=\-'
#: Pieces end where the tokenizer always splits: a run of letters before a blank or a mark, a run of
#: marks before a blank, or any run of non-blanks; of several blanks the last goes with what follows.
_PIECES = re.compile(
    f" ?[{_LETTERS}]++(?![^{_WS}{_MARKS}])| ?[{_MARKS}]++(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]"
)
#: Pieces of letters alone are one match of the splitting pattern, so the merges apply at once.
_LETTERS_ONLY = re.compile(f" ?[{_LETTERS}]+")


def default_path(name: str) -> str:
    """Path of a vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Odd(Exception):
    """A text that cannot be cut at single spaces, as blanks stand side by side."""


class _Kept(dict):
    """Ids by piece, computed when first met.  Two generations: when the younger is full the older is
    let go, and what is still used moves up.  Long pieces are not kept: a text without blanks is one
    piece, and whole documents would pile up."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > LONGEST_KEPT:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(list(ids), "<u4").tobytes()


_id_of = attrgetter("id")


#: What byte-level vocabularies write for a space.
_SPACE = "\u0120"


class PieceEncoder:
    """Encodes texts to little-endian 32-bit ids, reusing what it has encoded before."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT, pieces_kept: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.tokenize = self.library.model.tokenize
        self.shown = {b: c for c, b in byte_characters().items()}  # for str.translate, by code
        self.pieces = _Kept(pieces_kept, self._encode_piece)
        self.words = _Kept(words_kept, self._encode_word)

    def _merged(self, piece: str) -> bytes:
        """Ids of a piece that is one match of the splitting pattern."""
        shown = piece.encode().decode("latin-1").translate(self.shown)
        return _packed(map(_id_of, self.tokenize(shown)))

    def _encode_piece(self, piece: str) -> bytes:
        if piece[0] == " " and (known := self.words.get(piece[1:])) is not None:
            return known
        if _LETTERS_ONLY.fullmatch(piece):
            return self._merged(piece)
        return _packed(self.library.encode(piece, add_special_tokens=False).ids)

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))

    def _encode_word(self, word: str) -> bytes:
        """A word with the space before it.  If it is empty, or begins or ends with a blank, the
        space may belong to a longer run of blanks."""
        if word.isascii() and word.isalpha():  # bytes that stand for themselves
            return _packed(map(_id_of, self.tokenize(_SPACE + word)))
        if _LETTERS_ONLY.fullmatch(word):
            return self._merged(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        return self._joined(" " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian unsigned 32-bit numbers."""
        out, get = [], self.words.__getitem__
        for text in texts:
            head, *words = text.split(" ")
            try:
                out.append(self._joined(head) + b"".join(map(get, words)))
            except _Odd:
                out.append(self._joined(text))
        return out


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTable:
    """The bytes of every id, for decoding and for offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocabulary = {i: bytes(of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        for added in spec["added_tokens"]:
            vocabulary[added["id"]] = added["content"].encode()
        size = max(vocabulary) + 1
        self.tokens = [vocabulary.get(i) for i in range(size)]
        self.length = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id outside the vocabulary") from None

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets (start, end exclusive) of each token in the text whose UTF-8 is ``raw``.

        A token that holds part of a character spans the whole character.
        """
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.length[ids])
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(begins) - 1
        return character[ends - self.length[ids]], character[ends - 1] + 1


def encode(
    docs: DataFrame,
    text_col: str = "text",
    path: str | None = None,
    offsets: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``ids`` (array of int) and, if asked, ``starts`` and ``ends`` in characters."""

    def make():
        file = path or default_path("byte_bpe_50k.json")
        encoder, table = PieceEncoder(file), ByteTable(file)

        def run(texts):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder.encode(texts)]
            if not offsets:
                return [ids]
            spans = [table.offsets(i, t.encode()) for i, t in zip(ids, texts, strict=True)]
            return [ids, [s for s, _ in spans], [e for _, e in spans]]

        return run

    ints = T.ArrayType(T.IntegerType(), False)
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    return annotate(docs, text_col, make, [T.StructField(n, ints) for n in names], keep)


def decode(
    docs: DataFrame, ids_col: str = "ids", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Append ``decoded`` (binary): the bytes that ``ids_col`` stands for; null ids give none."""

    def make():
        table = ByteTable(path or default_path("byte_bpe_50k.json"))
        return lambda rows: [[table.decode(np.asarray(r or [], dtype=np.int64)) for r in rows]]

    return annotate(docs, ids_col, make, [T.StructField("decoded", T.BinaryType())], keep, nulls=True)


def digests(
    docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Encode, place every token in its text, decode, and keep only digests of all three.

    Appends ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space), ``decoded_sha256`` and
    ``n_split`` (tokens that begin or end inside a character).  The same code as :func:`encode`
    and :func:`decode` in one pass, so that no id array leaves the worker.
    """

    def make():
        file = path or default_path("byte_bpe_50k.json")
        encoder, table = PieceEncoder(file), ByteTable(file)
        decimal = [str(i) for i in range(len(table.tokens))]

        def sha(raw: bytes) -> str:
            return hashlib.sha256(raw).hexdigest()

        def run(texts):
            out = ([], [], [], [])
            for packed in encoder.encode(texts):
                ids = np.frombuffer(packed, "<u4")
                raw = table.decode(ids)
                starts, ends = table.offsets(ids, raw)
                split = int(np.count_nonzero(ends[:-1] > starts[1:])) if len(ids) else 0
                shown = " ".join(map(decimal.__getitem__, ids.tolist()))
                for column, value in zip(out, (len(ids), sha(shown.encode()), sha(raw), split), strict=True):
                    column.append(value)
            return out

        return run

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_split", T.LongType()),
    ]
    return annotate(docs, text_col, make, fields, keep)
