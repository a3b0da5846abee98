"""Operator 6: media columns.

Payloads live outside the table: each is stored once per shard as a lossless 8-bit grey PNG, named by
the SHA-256 of its bytes, in tar shards in the shared folder.  Rows carry digest, shard, offset and
length.  Metadata columns are filled by reading only the first bytes at a payload's offset; features
are computed from the samples that are read back.

A payload is the text as UTF-8, filled up with blanks to a positive multiple of ``ROW`` bytes, one
image row each.

A task writes shards of its own (named after its attempt), so that a lost or repeated task never
touches another's file; rows only ever name shards of attempts that succeeded.  Equal payloads of
several shards are all mapped to one of the copies.

Edge cases: a null or empty text is one row of blanks; a very long text is one tall image; equal
texts, repeated rows included, share all values, and of equally good places the first in the order
of shards counts; an empty table writes no shard and gives an empty result.  ``media_columns`` reads
the id and text columns only; in ``store`` a column named like an output gives way to it.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, by_place, column, lookup, materialize, scratch, texts_of

ROW = 192
#: Bytes after which a task begins a new shard, and the bytes of a PNG that hold its header.
SHARD_BYTES, HEADER = 256 << 20, 33
LEVEL = 6
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> tuple[bytes, int]:
    """The payload of a text, and its bytes before filling up."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, ``ROW`` samples wide, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first ``HEADER`` bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a PNG written by :func:`to_png`."""
    width, height, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG line")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, and the 64-bit average hash of the image: which of 64
    equal stretches are brighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    cut = len(samples) * np.arange(65) // 64
    sums = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    bright = np.diff(sums[cut]) * len(samples) > sums[-1] * np.diff(cut)
    bits = np.packbits(bright).tobytes().hex()
    return f"{samples.mean():.3f};{samples.std():.3f};{bits}"


def open_store(uri: str):
    """File system and path of a folder in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


ARROW = {T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}
PLACE = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("shard", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
])


def store(docs: DataFrame, folder: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Write payloads to tar shards under ``folder``; appends ``n_bytes``, ``digest``, ``shard``,
    ``offset`` and ``length``.  The result is written out, as shards must not be written twice."""
    new = {f.name for f in PLACE}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    out = T.StructType([docs.schema[c] for c in kept] + PLACE.fields)
    source = by_place(docs, [text_col, *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_store(folder)
        filesystem.create_dir(root, recursive=True)
        task, made, at, file, name = TaskContext.get(), 0, 0, None, ""
        places: dict[bytes, tuple[bytes, str, int, int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                columns: list[list] = [[] for _ in PLACE]
                for text in texts_of(part.column(0)):
                    payload, n_bytes = payload_of(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in places:
                        data = to_png(payload)
                        digest = hashlib.sha256(data).digest()
                        if file is None or at > SHARD_BYTES:
                            if file is not None:
                                file.write(b"\0" * 1024)
                                file.close()
                            name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.tar"
                            file, at, made = filesystem.open_output_stream(f"{root}/{name}"), 0, made + 1
                            places.clear()  # bounds memory; a shard holds a payload once
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(data)
                        head = info.tobuf(tarfile.PAX_FORMAT)
                        file.write(head + data + b"\0" * (-len(data) % 512))
                        places[key] = (digest, name, at + len(head), len(data))
                        at += len(head) + len(data) + -len(data) % 512
                    for column, value in zip(columns, (n_bytes, *places[key]), strict=True):
                        column.append(value)
                values = [pa.array(c, ARROW[f.dataType]) for c, f in zip(columns, PLACE, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *values], names=out.names)
        if file is not None:
            file.write(b"\0" * 1024)
            file.close()

    return materialize(source.mapInArrow(run, out), "media-rows")


def by_shard(table: DataFrame) -> DataFrame:
    """Deal payloads out to tasks by ranges of shards and offsets, which evens out their numbers."""
    tasks = max(1, table.select("shard").distinct().count())
    return table.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(table: DataFrame, folder: str, fields: list[T.StructField], read) -> DataFrame:
    """Append columns that ``read(file, offset, length)`` gives; rows are read in their order, so
    :func:`by_shard` should stand before."""
    out = T.StructType(table.schema.fields + fields)
    names, at = table.columns, {c: table.columns.index(c) for c in ("shard", "offset", "length")}
    types = [ARROW[f.dataType] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_store(folder)
        file, open_name = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(at[c]).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if name != open_name:
                    if file is not None:
                        file.close()
                    file, open_name = filesystem.open_input_file(f"{root}/{name}"), name
                rows.append(read(file, offset, length))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names + [f.name for f in fields])
        if file is not None:
            file.close()

    return table.mapInArrow(run, out)


def fill_metadata(table: DataFrame, folder: str) -> DataFrame:
    """Append ``width``, ``height`` and ``bits``, reading only the header at each offset."""
    fields = [T.StructField(n, T.LongType()) for n in ("width", "height", "bits")]
    return _ranges(table, folder, fields, lambda f, offset, length: png_header(f.read_at(HEADER, offset)))


def read_back(table: DataFrame, folder: str) -> DataFrame:
    """Append ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` and ``feature``, computed from
    the samples stored at each offset, and ``media_sha256`` of the stored bytes."""

    def read(file, offset: int, length: int):
        data = file.read_at(length, offset)
        payload = from_png(data)
        sha = hashlib.sha256
        return len(payload), sha(payload).digest(), zlib.crc32(payload[-16:]), feature_of(payload), sha(data).digest()

    fields = [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.BinaryType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("feature", T.StringType()),
        T.StructField("media_sha256", T.BinaryType()),
    ]
    return _ranges(table, folder, fields, read)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store all payloads, then give each row its place, header columns and features (digests in
    hexadecimal; before, they are bytes, to keep what is shuffled small).

    Stored bytes are read once per distinct payload, whatever the number of rows that share it.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    rows = store(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), folder, "text", keep=["id"])
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").alias("copies"))
    places = by_shard(places.select("digest", "copies", "p.shard", "p.offset", "p.length"))
    filled = materialize(read_back(fill_metadata(places, folder), folder), "media-columns")
    # a payload that many rows share is looked up by broadcast
    out = lookup(rows.select("id", "n_bytes", "digest"), filled, "digest", "copies", rows.count())
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")}
    return out.withColumns(hexed).withColumnRenamed("id", id_col)
