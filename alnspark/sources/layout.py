"""Byte layout of the binary container: headers, flags, compressed bitmaps."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..errors import ContainerHeaderError, ContainerVersionError, CorruptedInputErr, EncodeError, HeaderPromiseNotHonoured, InvalidConversion

# Fixed values of the format.
MAGIC = bytes([97, 104, 100, 97])
VERSION = 0
FILE_HEADER = struct.Struct("<6sBBHIIHIQ")
BLOCK_HEADER = struct.Struct("<IBHBIQHHQ")
PLAIN, GZIP = 0, 1
BITS_32, BITS_64 = 0, 1
HAS_NAMES, HAS_IDS = 1, 2
GZIP_HEAD = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255])
LEVEL = 6
COOKIE_PLAIN, COOKIE_RUNS = 12346, 12347
#: Numbers of one key that are listed rather than marked.
MOST_SPARSE = 4096
#: Numbers taken from a bitmap at once.
CHUNK = 1 << 16
U32 = 4294967295


def deflate(data: bytes) -> bytes:
    """A gzip member with a fixed head."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return GZIP_HEAD + body + struct.pack("<II", zlib.crc32(data), len(data) & U32)


def inflate(data: bytes) -> bytes:
    return gzip.decompress(data)


@dataclass
class FileHeader:
    n_targets: int
    n_queries: int
    bitmap_type: int
    block_size: int
    flags_len: int = 0
    fields_present: int = 0
    metadata_compression: int = GZIP
    file_format: int = 0

    def pack(self) -> bytes:
        return FILE_HEADER.pack(MAGIC + struct.pack("<H", VERSION), self.file_format, self.metadata_compression, self.fields_present,
                                self.n_targets, self.n_queries, self.bitmap_type, self.block_size, self.flags_len)

    @classmethod
    def unpack(cls, data: bytes) -> FileHeader:
        if len(data) < FILE_HEADER.size:
            raise CorruptedInputErr("a file header cut short")
        magic, form, compression, fields, n_targets, n_queries, kind, size, flags = FILE_HEADER.unpack(data[: FILE_HEADER.size])
        if magic[:4] != MAGIC:
            raise ContainerHeaderError("the file does not begin like a container")
        if magic[4:] != struct.pack("<H", VERSION):
            raise ContainerVersionError("the container's version is not known")
        return cls(n_targets, n_queries, kind, size, flags, fields, compression, form)


@dataclass
class BlockHeader:
    num_records: int
    block_len: int
    flags_len: int
    fields_present: int
    bitmap_type: int = BITS_32
    metadata_compression: int = GZIP

    def pack(self) -> bytes:
        return BLOCK_HEADER.pack(self.num_records, self.metadata_compression, self.bitmap_type, 0, self.block_len, self.flags_len,
                                 self.fields_present, 0, 0)

    @classmethod
    def unpack(cls, data: bytes) -> BlockHeader:
        if len(data) < BLOCK_HEADER.size:
            raise CorruptedInputErr("a block header cut short")
        n, compression, kind, _, block, flags, fields, _, _ = BLOCK_HEADER.unpack(data[: BLOCK_HEADER.size])
        return cls(n, block, flags, fields, kind, compression)


def put_number(n: int) -> bytes:
    """A number of varying length: one byte below 251, else a mark and two, four or eight bytes."""
    for mark, top, form in ((None, 251, "<B"), (251, 1 << 16, "<H"), (252, 1 << 32, "<I"), (253, 1 << 64, "<Q")):
        if n < top:
            return (b"" if mark is None else bytes([mark])) + struct.pack(form, n)
    raise EncodeError(f"number too large: {n}")


#: Marks of numbers that do not fit one byte, and the bytes that follow.
WIDTHS = {251: 2, 252: 4, 253: 8}


def put_numbers(values: list[int]) -> bytes:
    """The bytes of :func:`put_number` for each value, one after another."""
    try:
        v = np.asarray(values, np.uint64)
    except OverflowError as e:
        raise EncodeError("a number is negative or too large") from e
    bounds = [251, 1 << 16, 1 << 32]
    kind = np.searchsorted(np.array(bounds, np.uint64), v, side="right")
    length = np.array([1, *(1 + w for w in WIDTHS.values())])[kind]
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    out[at[kind == 0]] = v[kind == 0]
    for k, (mark, width) in enumerate(WIDTHS.items(), 1):
        own = kind == k
        out[at[own]] = mark
        for b in range(width):
            out[at[own] + 1 + b] = (v[own] >> np.uint64(8 * b)) & np.uint64(255)
    return out.tobytes()


class Cursor:
    """Reads the pieces of flags one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise CorruptedInputErr("flags cut short")
        self.at += n
        return got

    def number(self) -> int:
        first = self.take(1)[0]
        if first < 251:
            return first
        width = WIDTHS.get(first)
        if width is None:
            raise CorruptedInputErr("flags hold an unknown mark")
        return int.from_bytes(self.take(width), "little")

    def text(self) -> str:
        return self.take(self.number()).decode()

    def numbers(self, n: int) -> list[int]:
        """The next ``n`` numbers."""
        data, at, found = self.data, self.at, []
        try:
            for _ in range(n):
                first = data[at]
                at += 1
                if first >= 251:
                    width = WIDTHS[first]
                    first = int.from_bytes(data[at : at + width], "little")
                    at += width
                found.append(first)
        except IndexError as e:
            raise CorruptedInputErr("flags cut short") from e
        except KeyError as e:
            raise CorruptedInputErr("flags hold an unknown mark") from e
        if at > len(data):
            raise CorruptedInputErr("flags cut short")
        self.at = at
        return found

    def texts(self, n: int) -> list[str]:
        """The next ``n`` texts."""
        data, at, end, found = self.data, self.at, len(self.data), []
        for _ in range(n):
            if at < end and data[at] < 251:
                stop = at + 1 + data[at]
                if stop > end:
                    raise CorruptedInputErr("flags cut short")
                found.append(data[at + 1 : stop].decode())
                at = stop
            else:
                self.at = at
                found.append(self.text())
                at = self.at
        self.at = at
        return found


def _put_text(text: str) -> bytes:
    raw = text.encode()
    return put_number(len(raw)) + raw


#: The bytes of the numbers that fit one.
SHORT = [bytes([n]) for n in range(251)]


def _put_texts(texts: list[str]) -> bytes:
    return b"".join([SHORT[len(raw)] + raw if len(raw) < 251 else put_number(len(raw)) + raw for raw in map(str.encode, texts)])


def pack_flags(body: bytes, compression: int) -> bytes:
    return deflate(body) if compression == GZIP else body


def file_flags(sample: str, targets: list[str], compression: int = GZIP) -> bytes:
    return pack_flags(_put_text(sample) + put_number(len(targets)) + _put_texts(targets), compression)


def read_file_flags(data: bytes, compression: int) -> tuple[str, list[str]]:
    c = Cursor(inflate(data) if compression == GZIP else data)
    sample = c.text()
    return sample, c.texts(c.number())


def block_flags(names: list[str] | None, ids: list[int] | None, compression: int = GZIP) -> bytes:
    out = b"\0" if names is None else b"\1" + put_number(len(names)) + _put_texts(names)
    out += b"\0" if ids is None else b"\1" + put_number(len(ids)) + put_numbers(ids)
    return pack_flags(out, compression)


def read_block_flags(data: bytes, compression: int) -> tuple[list[str] | None, list[int] | None]:
    c = Cursor(inflate(data) if compression == GZIP else data)
    names = c.texts(c.number()) if c.take(1)[0] else None
    ids = c.numbers(c.number()) if c.take(1)[0] else None
    return names, ids


def default_block_size(n_targets: int, wide: bool) -> int:
    """Records of a block, so that narrow bit numbers fit."""
    if wide:
        return 262144
    most = min(U32 // max(n_targets, 1), 65537)
    return 2 if most == 1 else most - 1


def is_wide(n_targets: int, n_queries: int) -> bool:
    return n_targets * n_queries >= U32


def put_bitmap32(values: np.ndarray) -> bytes:
    """The portable form of a bitmap of ascending distinct 32-bit numbers, without runs.

    Work goes with the numbers: those of sparse keys, often one or two each, are written at once.
    """
    values = np.asarray(values, dtype=np.uint64)
    high = (values >> np.uint64(16)).astype("<u2")
    starts = np.flatnonzero(np.diff(high, prepend=~high[:1]))
    counts = np.diff(starts, append=len(values))
    low = values.astype("<u2")
    dense = counts > MOST_SPARSE
    sizes = np.where(dense, 8192, 2 * counts)
    head = struct.pack("<II", COOKIE_PLAIN, len(starts))
    index = np.column_stack([high[starts], (counts - 1).astype("<u2")]).astype("<u2")
    offsets = (len(head) + 8 * len(starts) + np.cumsum(sizes) - sizes).astype("<u4")
    out, done = [head, index.tobytes(), offsets.tobytes()], 0
    for i in np.flatnonzero(dense).tolist():
        s, e = int(starts[i]), int(starts[i] + counts[i])
        marks = np.zeros(65536, np.uint8)
        marks[low[s:e]] = 1
        out += [low[done:s].tobytes(), np.packbits(marks, bitorder="little").tobytes()]
        done = e
    return b"".join([*out, low[done:].tobytes()])


def bitmap_chunks(data: bytes, kind: int) -> Iterator[np.ndarray]:
    """The ascending numbers of an inflated bitmap, at most 65,536 at once and, but for the last
    chunk, at least half as many."""
    try:
        held, count = [], 0
        for low in _pieces(data, kind):
            if count + len(low) > CHUNK:
                yield np.concatenate(held)
                held, count = [], 0
            held.append(low)
            count += len(low)
        if held:
            yield np.concatenate(held)
    except (struct.error, ValueError) as e:
        raise CorruptedInputErr("a bitmap cut short") from e


def _pieces(data: bytes, kind: int) -> Iterator[np.ndarray]:
    if kind == BITS_32:
        yield from (low for low, _ in _chunks32(data, 0))
        return
    (n,), at = struct.unpack_from("<Q", data, 0), 8
    for _ in range(n):
        (key,) = struct.unpack_from("<I", data, at)
        at += 4
        for low, at in _chunks32(data, at):  # noqa: B020 - the next bitmap begins where this one ends
            yield low + (key << 32)


def _chunks32(data: bytes, at: int) -> Iterator[tuple[np.ndarray, int]]:
    """The numbers of a portable bitmap, at most 65,536 at once, and where those read so far end; at
    least one chunk.  Keys whose numbers are listed are read many at once."""
    (cookie,) = struct.unpack_from("<I", data, at)
    at += 4
    runs = b""
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        runs = data[at : at + (n + 7) // 8]
        at += len(runs)
    elif cookie == COOKIE_PLAIN:
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
    else:
        raise CorruptedInputErr("not a bitmap")
    index = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if not runs or n >= 4:
        at += 4 * n
    if not n:
        yield np.zeros(0, np.int64), at
    keys, counts = index[:, 0] << 16, index[:, 1] + 1
    run = np.unpackbits(np.frombuffer(runs, np.uint8), bitorder="little")[:n].astype(bool) if runs else np.zeros(n, bool)
    alone = np.append(np.flatnonzero(run | (counts > MOST_SPARSE)), n)
    upto = np.cumsum(counts)
    i = 0
    while i < n:
        end = int(alone[np.searchsorted(alone, i)])
        if end > i:  # listed keys, as many as make a chunk
            end = min(end, int(np.searchsorted(upto, upto[i] - counts[i] + CHUNK, side="right")))
            count = int(upto[end - 1] - upto[i] + counts[i])
            low = np.frombuffer(data, "<u2", count, at) + np.repeat(keys[i:end], counts[i:end])
            at += 2 * count
            i = end
        else:
            if run[i]:
                (count,) = struct.unpack_from("<H", data, at)
                pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(count, 2).astype(np.int64)
                at += 2 + 4 * count
                low = np.concatenate([np.arange(s, s + more + 1) for s, more in pairs]) if count else np.zeros(0, np.int64)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            low = low + keys[i]
            i += 1
        yield low, at


def take_bitmap32(data: bytes) -> np.ndarray:
    """The numbers of a portable bitmap."""
    return np.concatenate(list(bitmap_chunks(data, BITS_32)))


def put_bitmap64(values: np.ndarray) -> bytes:
    values = np.asarray(values, dtype=np.uint64)
    keys, starts = np.unique(values >> np.uint64(32), return_index=True)
    ends = np.append(starts[1:], len(values))[: len(starts)]
    out = [struct.pack("<Q", len(keys))]
    for key, s, e in zip(keys.tolist(), starts.tolist(), ends.tolist(), strict=True):
        out += [struct.pack("<I", key), put_bitmap32(values[s:e] & np.uint64(U32))]
    return b"".join(out)


def pack_bitmap(values: np.ndarray, kind: int) -> bytes:
    """Compressed bitmap of ascending distinct numbers."""
    if kind == BITS_32 and len(values) and int(values[-1]) > U32:
        raise InvalidConversion("a bit number needs the wide bitmap")
    return deflate(put_bitmap64(values) if kind == BITS_64 else put_bitmap32(values))


def unpack_bitmap(data: bytes, kind: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *bitmap_chunks(inflate(data), kind)])


@dataclass
class Block:
    """One block: ids and names of its queries in order, and its bits."""

    ids: list[int]
    names: list[str] | None
    bits: np.ndarray
    bitmap_type: int = BITS_32
    compression: int = GZIP
    header: BlockHeader | None = field(default=None, compare=False)

    def pack(self) -> bytes:
        if self.ids and not 0 <= min(self.ids) <= max(self.ids) <= U32:
            raise InvalidConversion("a query id does not fit 32 bits")
        flags = block_flags(self.names, self.ids, self.compression)
        bitmap = pack_bitmap(self.bits, self.bitmap_type)
        fields = HAS_IDS | (HAS_NAMES if self.names is not None else 0)
        head = BlockHeader(len(self.ids), len(bitmap), len(flags), fields, self.bitmap_type, self.compression)
        return head.pack() + flags + bitmap

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        head = BlockHeader.unpack(data)
        at = BLOCK_HEADER.size
        if len(data) < at + head.flags_len + head.block_len:
            raise CorruptedInputErr("a block cut short")
        names, ids = read_block_flags(data[at : at + head.flags_len], head.metadata_compression)
        if (names is None) == bool(head.fields_present & HAS_NAMES) or (ids is None) == bool(head.fields_present & HAS_IDS):
            raise HeaderPromiseNotHonoured("a block holds other fields than its header announces")
        bits = unpack_bitmap(data[at + head.flags_len : at + head.flags_len + head.block_len], head.bitmap_type)
        return cls(ids if ids is not None else [], names, bits, head.bitmap_type, head.metadata_compression, head)
