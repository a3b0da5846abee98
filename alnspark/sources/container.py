"""The binary container as a Spark data source and a writer.

A container is one file, or a folder with the file header (``head``), one file a block, and a list
of the blocks in order (``blocks``), which is written last and makes the folder complete.  A folder
is written and read without any bytes of blocks passing through the driver; :func:`join` makes one
file of it.

Reading: the driver walks block headers (of a folder, the list); an input partition is one block, or
several small ones that follow each other.  The file header is read once, for all of them.
``view`` says what is read, as a Python source cannot be pruned by column: ``records``, ``edges``,
``queries`` (ids and names from the flags, without bitmaps) or ``index`` (one row a block).  Bitmaps
are taken apart 65,536 numbers at a time, so that a dense block is never held as numbers.

Writing: records are shuffled once by block and packed as they stream by.  A block is also cut where
it would hold more than ``MOST_HITS`` hits, so packing is bounded whatever the number of targets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..errors import CorruptedInputErr, HeaderPromiseNotHonoured, IncompatibleFileHeadersErr, QueryIdsNotFilled, QueryNamesNotFilled, SetBitsNotSorted
from ..model import Alignment, dense_places, dense_rank_by
from ..workspace import materialize
from . import layout
from .text import target_table

VIEWS = {
    "records": "query_id long, query_name string, ones array<long>, block_id long",
    "edges": "query_id long, target_id long",
    "queries": "query_id long, query_name string, block_id long",
    "index": "block_id long, offset long, num_records long, bitmap_type int, flags_len long, block_len long, first_id long, last_id long, "
             "has_names boolean, foreign long",
}
#: Hits after which a block is cut, and hits of one batch that a reader gives.
MOST_HITS, BATCH_HITS = 1 << 22, 1 << 20
#: Bytes of small blocks that one task reads: so many, or what makes ``READ_TASKS`` tasks if that is
#: less, but not below the least.
READ_BYTES, READ_LEAST, READ_TASKS = 1 << 20, 1 << 16, 64
CHUNK = 1 << 22


def file_system(uri: str):
    """File system and path of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def is_folder(uri: str) -> bool:
    from pyarrow import fs

    system, path = file_system(uri)
    return system.get_file_info(path).type == fs.FileType.Directory


def read_head(uri: str) -> tuple[layout.FileHeader, str, list[str], int]:
    """File header, sample, target names, and the offset of the first block."""
    system, path = file_system(f"{uri}/head" if is_folder(uri) else uri)
    with system.open_input_file(path) as f:
        head = layout.FileHeader.unpack(f.read_at(layout.FILE_HEADER.size, 0))
        flags = f.read_at(head.flags_len, layout.FILE_HEADER.size)
    sample, targets = layout.read_file_flags(flags, head.metadata_compression)
    return head, sample, targets, layout.FILE_HEADER.size + head.flags_len


def read_header(uri: str) -> layout.FileHeader:
    """The file header alone, without sample and target names."""
    system, path = file_system(f"{uri}/head" if is_folder(uri) else uri)
    with system.open_input_file(path) as f:
        return layout.FileHeader.unpack(f.read_at(layout.FILE_HEADER.size, 0))


def walk_blocks(uri: str) -> Iterator[tuple[int, layout.BlockHeader]]:
    """Offset and header of every block of a file, reading headers only; anything after the last is
    an error."""
    _, _, _, at = read_head(uri)
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        while at < size:
            head = layout.BlockHeader.unpack(f.read_at(layout.BLOCK_HEADER.size, at))
            length = layout.BLOCK_HEADER.size + head.flags_len + head.block_len
            if at + length > size:
                raise CorruptedInputErr("a block cut short")
            yield at, head
            at += length


class BlockAt:
    """Where a block lies; its ids' range, if the list of a folder says it."""

    def __init__(self, number: int, uri: str, offset: int, length: int, ids: tuple[int, int] | None = None):
        self.number, self.uri, self.offset, self.length, self.ids = number, uri, offset, length, ids


class Blocks(InputPartition):
    """Blocks that one task reads, and the header of their container."""

    def __init__(self, number: int, blocks: list[BlockAt], promised: layout.FileHeader):
        super().__init__(number)
        self.blocks, self.promised = blocks, promised


def in_groups(blocks: list[BlockAt]) -> Iterator[list[BlockAt]]:
    """Blocks in order, small ones together."""
    most = min(READ_BYTES, max(READ_LEAST, sum(b.length for b in blocks) // READ_TASKS))
    held, size = [], 0
    for b in blocks:
        if held and size + b.length > most:
            yield held
            held, size = [], 0
        held.append(b)
        size += b.length
    if held:
        yield held


def block_list(uri: str) -> Iterator[BlockAt]:
    """The blocks of a container in order."""
    if not is_folder(uri):
        for i, (at, h) in enumerate(walk_blocks(uri)):
            yield BlockAt(i, uri, at, layout.BLOCK_HEADER.size + h.flags_len + h.block_len)
        return
    system, path = file_system(f"{uri}/blocks")
    with system.open_input_stream(path) as f:
        for i, line in enumerate(f.read().decode().splitlines()):
            name, length, first, last = json.loads(line)
            yield BlockAt(i, f"{uri}/{name}", 0, length, (first, last))


def info(uri: str) -> dict:
    """Metadata of a container.  Where the header does not count the queries, the blocks do."""
    head, sample, targets, _ = read_head(uri)
    counted = head.n_queries
    if not counted:
        counted = sum(len(ids or []) for _, ids in _all_flags(uri))
    return {"sample": sample, "targets": targets, "n_targets": head.n_targets, "n_queries": counted, "block_size": head.block_size,
            "bitmap_type": head.bitmap_type, "fields_present": head.fields_present, "metadata_compression": head.metadata_compression}


def _batch(view: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in VIEWS[view].split(", ")])


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def _edges(chunks: Iterator[np.ndarray], n_targets: int) -> Iterator[pa.RecordBatch]:
    for bits in chunks:
        query, target = np.divmod(bits, n_targets)
        yield _batch("edges", _longs(query), _longs(target))


def _rows(chunks: Iterator[np.ndarray], n_targets: int, ids: np.ndarray, names: list | None, number: int) -> Iterator[pa.RecordBatch]:
    """Records of a block, by id: its own queries, and those of another block it holds bits of.

    Numbers are gathered up to ``BATCH_HITS`` and given as far as their queries are complete.
    """
    done = 0

    def given(query: np.ndarray, target: np.ndarray, upto: int) -> pa.RecordBatch:
        nonlocal done
        own = ids[done:upto]
        every = np.union1d(own, query) if len(query) else own
        counts = np.searchsorted(query, every, side="right") - np.searchsorted(query, every)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        if names is None:
            named = pa.nulls(len(every), pa.string())
        else:
            place = dict(zip(own.tolist(), names[done:upto], strict=True))
            named = pa.array([place.get(q) for q in every.tolist()], pa.string())
        done = upto
        ones = pa.ListArray.from_arrays(pa.array(offsets), _longs(target))
        return _batch("records", _longs(every), named, ones, _longs(np.full(len(every), number)))

    held, count = [], 0
    for bits in chunks:
        held.append(bits)
        count += len(bits)
        if count >= BATCH_HITS:
            query, target = np.divmod(np.concatenate(held), n_targets)
            whole = int(np.searchsorted(query, query[-1]))  # the last query may go on
            if whole:
                yield given(query[:whole], target[:whole], int(np.searchsorted(ids, query[-1])))
                held, count = [query[whole:] * n_targets + target[whole:]], len(query) - whole
    query, target = np.divmod(np.concatenate([np.zeros(0, np.int64), *held]), n_targets)
    while True:
        upto = min(done + (1 << 16), len(ids))
        last = upto == len(ids)
        cut = len(query) if last else int(np.searchsorted(query, ids[upto]))
        if upto > done or cut:
            yield given(query[:cut], target[:cut], upto)
        if last:
            return
        query, target = query[cut:], target[cut:]


def _foreign(query: np.ndarray, ids: np.ndarray) -> int:
    """Numbers whose query is none of the ascending ids."""
    if not len(ids):
        return len(query)
    place = np.minimum(np.searchsorted(ids, query), len(ids) - 1)
    return int((ids[place] != query).sum())


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, view: str):
        self.path, self.view, self.query_id = path, view, None

    def partitions(self):
        """Groups of blocks; blocks of a folder whose ids do not reach a wanted one are left out."""
        wanted = self.query_id
        blocks = [b for b in block_list(self.path) if wanted is None or b.ids is None or b.ids[0] <= wanted <= b.ids[1]]
        promised = read_header(self.path)
        return [Blocks(i, group, promised) for i, group in enumerate(in_groups(blocks))]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        for block in part.blocks:
            yield from self.read_block(block, part.promised)

    def read_block(self, block: BlockAt, promised: layout.FileHeader) -> Iterator[pa.RecordBatch]:
        system, path = file_system(block.uri)
        with system.open_input_file(path) as f:
            head = layout.BlockHeader.unpack(f.read_at(layout.BLOCK_HEADER.size, block.offset))
            at = block.offset + layout.BLOCK_HEADER.size
            names, ids = layout.read_block_flags(f.read_at(head.flags_len, at), head.metadata_compression)
            have = (layout.HAS_NAMES if names is not None else 0) | (layout.HAS_IDS if ids is not None else 0)
            if not head.fields_present == have == promised.fields_present:
                raise HeaderPromiseNotHonoured("a block holds other fields than its headers announce")
            if self.query_id is not None and self.query_id not in (ids or []):
                return
            if self.view == "queries":
                yield _batch("queries", _longs(ids or []), pa.array(names if names is not None else [None] * len(ids or []), pa.string()),
                             _longs([block.number] * len(ids or [])))
                return
            raw = layout.inflate(f.read_at(head.block_len, at + head.flags_len))
        n_targets = max(promised.n_targets, 1)
        chunks = layout.bitmap_chunks(raw, head.bitmap_type)
        if self.view == "edges":
            yield from _edges(chunks, n_targets)
            return
        order = np.argsort(np.asarray(ids or [], np.int64), kind="stable")
        sorted_ids = np.asarray(ids or [], np.int64)[order]
        if self.view == "records":
            own = None if names is None else [names[i] for i in order]
            yield from _rows(chunks, n_targets, sorted_ids, own, block.number)
            return
        foreign = sum(_foreign(bits // n_targets, sorted_ids) for bits in chunks)
        first, last = (int(sorted_ids[0]), int(sorted_ids[-1])) if len(sorted_ids) else (-1, -1)
        numbers = [block.number, block.offset, head.num_records]
        rest = [head.flags_len, head.block_len, first, last]
        yield _batch("index", *[_longs([v]) for v in numbers], pa.array([head.bitmap_type], pa.int32()), *[_longs([v]) for v in rest],
                     pa.array([names is not None]), _longs([foreign]))


class PruningReader(ContainerReader):
    """Skips blocks by query id; Spark allows it where Python filter pushdown is switched on."""

    def pushFilters(self, filters):
        """Blocks that cannot hold a wanted id are skipped; all filters are checked again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query_id",):
                self.query_id = f.value
            yield f


class ContainerSource(DataSource):
    """``spark.read.format("pseudoaln").option("view", ...).load(path)``; with the option ``prune``
    and ``spark.sql.python.filterPushdown.enabled``, blocks without a wanted query are skipped."""

    @classmethod
    def name(cls) -> str:
        return "pseudoaln"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "records")]

    def reader(self, schema) -> ContainerReader:
        kind = PruningReader if self.options.get("prune", "false") == "true" else ContainerReader
        return kind(self.options["path"], self.options.get("view", "records"))


def read_view(spark: SparkSession, uri: str, view: str = "records") -> DataFrame:
    spark.dataSource.register(ContainerSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pseudoaln").option("view", view).option("prune", prune).load(uri)


def _sound(spark: SparkSession, uri: str) -> bool:
    """Whether every query lies in one block only: id ranges do not overlap, and no block holds bits
    of another's queries."""
    rows = read_view(spark, uri, "index").select("first_id", "last_id", "foreign").collect()  # one row a block
    ranges = sorted((r["first_id"], r["last_id"]) for r in rows if r["last_id"] >= 0)
    apart = all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    return apart and not any(r["foreign"] for r in rows)


def _named(query_name, sample: str):
    return F.coalesce(query_name, F.concat(F.lit(sample + "."), F.col("query_id") + 1))


def read_queries(spark: SparkSession, uri: str) -> DataFrame:
    """(query_id, query_name) of a container, from the flags alone; names missing there are the
    sample, a dot and id plus one."""
    _, sample, _, _ = read_head(uri)
    found = read_view(spark, uri, "queries").groupBy("query_id").agg(F.max("query_name").alias("query_name"))
    return found.select("query_id", _named(F.col("query_name"), sample).alias("query_name"))


def read_container(spark: SparkSession, uri: str) -> Alignment:
    """Records with dictionaries.

    Blocks with separate queries are read without a shuffle.  Otherwise bits that a block holds for
    queries of another block are gathered with those, by id over all blocks; the query universe
    comes from the flags of all blocks.  Queries without names get the sample, a dot and id plus one.
    """
    _, sample, targets, _ = read_head(uri)
    records = read_view(spark, uri)
    if not _sound(spark, uri):
        records = records.groupBy("query_id").agg(
            F.max("query_name").alias("query_name"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("ones")))).alias("ones"),
            F.max("block_id").alias("block_id"),
        )
    records = records.withColumn("query_name", _named(F.col("query_name"), sample))
    records = records.withColumn("ones_names", F.lit(None).cast("array<string>"))
    return Alignment(records, target_table(spark, targets), read_queries(spark, uri), sample)


DECODE_ORDER = ["block_id", "no_hits", "query_id"]


def decode_order(records: DataFrame) -> DataFrame:
    """Append ``no_hits``: by :data:`DECODE_ORDER` records stand as a container gives them, block by
    block, queries with hits first, each by id."""
    return records.withColumn("no_hits", F.size("ones") == 0)


def _packer(n_targets: int, kind: int, size: int, compression: int, names: bool):
    """Reads (block_id, query_id, query_name, ones) sorted by block and id; gives (block_id, part,
    first_id, last_id, data), one row a block."""

    def packed(block: int, part: int, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        own_ids = table.column("query_id").to_numpy()
        ids = own_ids.tolist()
        hits = table.column("ones").combine_chunks()
        owner = np.repeat(own_ids, np.diff(hits.offsets.to_numpy()))
        target = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(target) and not 0 <= int(target.min()) <= int(target.max()) < max(n_targets, 1):
            raise CorruptedInputErr("IndexNotFound: a target outside the dictionary")
        bits = np.unique(owner * n_targets + target)
        own = table.column("query_name").to_numpy().tolist() if names else None
        if own is not None and None in own:
            raise QueryNamesNotFilled("a record has no query name")
        data = layout.Block(ids, own, bits, kind, compression).pack()
        row = {"block_id": [block], "part": [part], "first_id": [ids[0]], "last_id": [ids[-1]]}
        return pa.RecordBatch.from_arrays([*(_longs(v) for v in row.values()), pa.array([data], pa.binary())], names=[*row, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, held, rows, hits = None, 0, [], 0, 0
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if blocks[at] != block or rows >= size or hits >= MOST_HITS:
                    if held:
                        yield packed(block, part, held)
                    part = part + 1 if blocks[at] == block else 0
                    block, held, rows, hits = int(blocks[at]), [], 0, 0
                end = min(int(np.searchsorted(blocks, block, side="right")), at + size - rows)
                total = hits + np.cumsum(lengths[at:end])
                end = at + min(end - at, int(np.searchsorted(total, MOST_HITS)) + 1)
                held.append(batch.slice(at, end - at))
                rows, hits, at = rows + end - at, int(total[end - at - 1]), end
        if held:
            yield packed(block, part, held)

    return run


def write_container(
    a: Alignment,
    uri: str,
    sample: str | None = None,
    block_size: int | None = None,
    compression: int = layout.GZIP,
    names: bool = True,
    by: str = "query_id",
    folder: bool = False,
    query_names: DataFrame | None = None,
    written: bool = False,
) -> None:
    """Write records (one row a query, ``ones`` filled) as one container.

    ``by``: ``query_id`` cuts blocks by id divided by the block size; ``row_idx`` gives every block
    so many records in input order.  A null ``ones`` counts as empty.  ``folder``: leave the blocks
    in files of their own.  ``query_names`` (query_id, query_name) replaces the records' names.
    ``written``: the records are read from a table and need not be written to one first.
    """
    targets = [r["target_name"] for r in a.targets.orderBy("target_id").toLocalIterator()]
    ones = F.coalesce("ones", F.array().cast("array<bigint>")).alias("ones")
    name = F.col("query_name") if "query_name" in a.records.columns else F.lit(None).cast("string").alias("query_name")
    place = [c for c in ("row_idx",) if by == c]
    records = a.records.select("query_id", name, ones, *place)
    if query_names is not None:
        from ..operators.resolve import fill_query_names

        bare = records.withColumn("query_name", F.lit(None).cast("string"))
        records = fill_query_names(Alignment(bare, a.targets, query_names)).records
    if not written:
        records = materialize(records, "records")
    if place:
        at = dense_places(records, "row_idx")
        records = dense_rank_by(records, "row_idx", "__place") if at is None else records.withColumn("__place", at)
    top = records.agg(F.count("*").alias("n"), F.max("query_id").alias("top"), F.count("query_id").alias("ids")).first()
    if top["ids"] < top["n"]:
        raise QueryIdsNotFilled("a record has no query id")
    wide = layout.is_wide(len(targets), max(top["n"], (top["top"] or 0) + 1))
    size = block_size or layout.default_block_size(len(targets), wide)
    if not wide:
        size = max(1, min(size, layout.U32 // max(len(targets), 1)))
    kind = layout.BITS_64 if wide else layout.BITS_32
    block = F.floor(F.col("__place" if place else "query_id") / size).cast("long").alias("block_id")
    rows = records.select(block, "query_id", "query_name", "ones").repartition("block_id").sortWithinPartitions("block_id", "query_id")
    packed = rows.mapInArrow(_packer(len(targets), kind, size, compression, names), "block_id long, part long, first_id long, last_id long, data binary")
    fields = layout.HAS_IDS | (layout.HAS_NAMES if names else 0)
    flags = layout.file_flags(a.sample if sample is None else sample, targets, compression)
    head = layout.FileHeader(len(targets), top["n"], kind, size, len(flags), fields, compression)
    _write_folder(packed, head.pack() + flags, uri, folder)


def _write_folder(blocks: DataFrame, head: bytes, uri: str, keep: bool) -> None:
    """Write rows (block_id, part, first_id, last_id, data) as a folder, where executors put the
    blocks; joined to one file unless that folder is to be kept."""
    own = uri if keep else f"{uri}.parts-{uuid.uuid4().hex}"
    system, path = file_system(own)
    system.create_dir(path, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = file_system(own)
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                name = f"block-{r['block_id']:020d}-{r['part']:06d}-{uuid.uuid4().hex}"
                with there.open_output_stream(f"{root}/{name}") as f:
                    f.write(r["data"])
                made.append({**{k: r[k] for k in ("block_id", "part", "first_id", "last_id")}, "name": name, "length": len(r["data"])})
            if made:
                yield pa.RecordBatch.from_pylist(made)

    schema = "block_id long, part long, first_id long, last_id long, name string, length long"
    done = blocks.mapInArrow(put, schema).collect()  # one row a block: names only
    listed = [json.dumps([r["name"], r["length"], r["first_id"], r["last_id"]]) for r in sorted(done)]
    for name, data in (("head", head), ("blocks", "\n".join(listed).encode())):
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(data)
    if not keep:
        join(own, uri)
        system.delete_dir(path)


def join(folder: str, uri: str) -> None:
    """One file of a folder: the header and the blocks, copied a few MB at a time."""
    system, path = file_system(folder)
    there, name = file_system(uri)
    with there.open_output_stream(name) as out:
        for part in ["head", *[b.uri.rsplit("/", 1)[1] for b in block_list(folder)]]:
            with system.open_input_stream(f"{path}/{part}") as f:
                while chunk := f.read(CHUNK):
                    out.write(chunk)


def append(spark: SparkSession, sources: list[str], uri: str, compression: int = layout.GZIP, folder: bool = False) -> None:
    """Concatenate containers without taking bitmaps apart: executors copy the blocks; only flags are
    packed again, if they are compressed otherwise.  Sample and targets are those of the first.

    Targets and fields must be equal and ids must be there; that no query occurs twice is for the
    caller to check.
    """
    heads = [read_head(s) for s in sources]
    first, sample, targets, _ = heads[0]
    for head, _, own, _ in heads[1:]:
        if own != targets or head.n_targets != first.n_targets:
            raise IncompatibleFileHeadersErr("inputs have different targets")
        if head.fields_present != first.fields_present:
            raise IncompatibleFileHeadersErr("inputs hold different fields")
    if not first.fields_present & layout.HAS_IDS:
        raise QueryIdsNotFilled("an input lacks query ids")
    total = sum(h.n_queries or info(s)["n_queries"] for s, (h, _, _, _) in zip(sources, heads, strict=True))
    flags = layout.file_flags(sample, targets, compression)
    kind = max(h.bitmap_type for h, _, _, _ in heads)
    head = layout.FileHeader(first.n_targets, total, kind, max(h.block_size for h, _, _, _ in heads), len(flags), first.fields_present, compression)
    every = [(k, b.uri, b.offset, b.length) for k, b in enumerate(b for s in sources for b in block_list(s))]
    rows = spark.createDataFrame(every, "block_id long, uri string, offset long, length long")
    rows = rows.repartition(max(1, min(len(every), 10_000)))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = file_system(r["uri"])
                with system.open_input_file(path) as f:
                    data = f.read_at(r["length"], r["offset"])
                own = layout.BlockHeader.unpack(data)
                at = layout.BLOCK_HEADER.size
                names, ids = layout.read_block_flags(data[at : at + own.flags_len], own.metadata_compression)
                if own.metadata_compression != compression:
                    packed = layout.block_flags(names, ids, compression)
                    fresh = layout.BlockHeader(own.num_records, own.block_len, len(packed), own.fields_present, own.bitmap_type, compression)
                    data = fresh.pack() + packed + data[at + own.flags_len :]
                row = {"block_id": r["block_id"], "part": 0, "first_id": min(ids or [-1]), "last_id": max(ids or [-1])}
                yield pa.RecordBatch.from_arrays([*(_longs([v]) for v in row.values()), pa.array([data], pa.binary())], names=[*row, "data"])

    _write_folder(rows.mapInArrow(copy, "block_id long, part long, first_id long, last_id long, data binary"), head.pack() + flags, uri, folder)


# Helpers for single pieces, for callers that hold bytes.


def encode_file_header_and_flags(sample: str, targets: list[str], n_queries: int, names: bool = True, compression: int = layout.GZIP,
                                 block_size: int | None = None) -> bytes:
    wide = layout.is_wide(len(targets), n_queries)
    flags = layout.file_flags(sample, targets, compression)
    fields = layout.HAS_IDS | (layout.HAS_NAMES if names else 0)
    size = block_size or layout.default_block_size(len(targets), wide)
    return layout.FileHeader(len(targets), n_queries, int(wide), size, len(flags), fields, compression).pack() + flags


def _ascending(bits) -> np.ndarray:
    values = np.asarray(list(bits), np.int64)
    if (np.diff(values) <= 0).any():
        raise SetBitsNotSorted("set bits must ascend")
    return values


def encode_block(bits, ids: list[int], names: list[str] | None = None, wide: bool = False) -> bytes:
    """One block; the bits must ascend."""
    return layout.Block(ids, names, _ascending(bits), int(wide)).pack()


def encode_bitmap(bits, wide: bool = False) -> bytes:
    """One compressed bitmap; the bits must ascend."""
    return layout.pack_bitmap(_ascending(bits), int(wide))


def decode_bitmap(data: bytes, wide: bool = False) -> list[int]:
    return layout.unpack_bitmap(data, int(wide)).tolist()


def decode_target_names(uri: str) -> list[str]:
    return read_head(uri)[2]


def decode_query_ids(uri: str) -> list[int]:
    return [i for names, ids in _all_flags(uri) for i in ids or []]


def decode_query_names(uri: str) -> list[str]:
    return [n for names, ids in _all_flags(uri) for n in names or []]


def _all_flags(uri: str):
    for b in block_list(uri):
        system, path = file_system(b.uri)
        with system.open_input_file(path) as f:
            head = layout.BlockHeader.unpack(f.read_at(layout.BLOCK_HEADER.size, b.offset))
            yield layout.read_block_flags(f.read_at(head.flags_len, b.offset + layout.BLOCK_HEADER.size), head.metadata_compression)
