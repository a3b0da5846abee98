import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alnspark.errors import ContainerHeaderError, ContainerVersionError, CorruptedInputErr
from alnspark.model import Alignment
from alnspark.sources import container, layout
from alnspark.sources.text import target_table


@given(st.sets(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
@settings(max_examples=40, deadline=None)
def test_bitmap_round_trip(values, wide):
    bits = sorted(values | ({v << 20 for v in values} if wide else set()))
    assert container.decode_bitmap(container.encode_bitmap(bits, wide), wide) == bits


def test_bitmap_forms():
    dense = np.arange(10, 9010)
    raw = layout.put_bitmap32(dense)
    assert struct.unpack_from("<IIHHI", raw) == (12346, 1, 0, 8999, 16) and len(raw) == 16 + 8192
    assert layout.take_bitmap32(raw).tolist() == dense.tolist()
    runs = struct.pack("<IBHHHHHHH", 12347 | 0 << 16, 1, 0, 6, 2, 5, 2, 20, 3)
    assert layout.take_bitmap32(runs).tolist() == [5, 6, 7, 20, 21, 22, 23]
    with pytest.raises(CorruptedInputErr):
        layout.take_bitmap32(raw[:100])


@given(st.one_of(st.none(), st.lists(st.text(max_size=300), max_size=300)), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([0, 1]))
@settings(max_examples=40, deadline=None)
def test_flags_round_trip(names, ids, compression):
    assert layout.read_block_flags(layout.block_flags(names, ids, compression), compression) == (names, ids)


def test_numbers_and_headers():
    for n, width in ((250, 1), (251, 3), (65535, 3), (65536, 5), (2**32, 9)):
        assert len(layout.put_number(n)) == width and layout.Cursor(layout.put_number(n)).number() == n
    head = layout.FileHeader(2, 5, 0, 65536, 51, 3)
    assert len(head.pack()) == 32 and layout.FileHeader.unpack(head.pack()) == head
    with pytest.raises(ContainerHeaderError):
        layout.FileHeader.unpack(b"xxxx" + head.pack()[4:])
    with pytest.raises(ContainerVersionError):
        layout.FileHeader.unpack(head.pack()[:4] + b"\1\0" + head.pack()[6:])
    assert len(layout.file_flags("ERR4035126", ["chr.fasta", "plasmid.fasta"], layout.PLAIN)) == 36
    assert (layout.default_block_size(2, False), layout.default_block_size(100_000, False), layout.default_block_size(2, True)) == (65536, 42948, 262144)


def alignment(spark, rows, targets):
    records = spark.createDataFrame(rows, "query_id long, query_name string, ones array<long>, row_idx long")
    return Alignment(records, target_table(spark, targets), None, "S")


def test_blocks_names_and_padding(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    rows = [(1, "b", [0], 0), (0, "a", [0], 1), (2, "c", [0, 1], 2), (4, "e", [], 3), (3, "d", [1], 4)]
    container.write_container(alignment(spark, rows, ["x", "y"]), path, block_size=2, by="row_idx")
    blocks = container.read_view(spark, path, "index").orderBy("block_id").collect()
    assert [(b.num_records, b.first_id, b.last_id) for b in blocks] == [(2, 0, 1), (2, 2, 4), (1, 3, 3)]
    assert sorted(tuple(r) for r in container.read_view(spark, path, "edges").collect()) == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 1)]
    got = container.read_container(spark, path).records.orderBy("query_id").collect()
    assert [(r.query_id, r.query_name, r.ones) for r in got] == [(0, "a", [0]), (1, "b", [0]), (2, "c", [0, 1]), (3, "d", [1]), (4, "e", [])]
    assert container.decode_query_ids(path) == [0, 1, 2, 4, 3] and container.decode_target_names(path) == ["x", "y"]
    assert container.info(path)["n_queries"] == 5
    with pytest.raises(CorruptedInputErr):
        (tmp_path / "b.bin").write_bytes((tmp_path / "a.bin").read_bytes() + b"\0")
        list(container.walk_blocks(str(tmp_path / "b.bin")))


def test_names_left_out_and_wide_bits(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    container.write_container(alignment(spark, [(4_000_000_000, None, [1, 2], 0)], ["x", "y", "z"]), path, names=False)
    assert container.info(path)["bitmap_type"] == layout.BITS_64
    got = container.read_container(spark, path).records.collect()
    assert [(r.query_id, r.query_name, r.ones) for r in got] == [(4_000_000_000, "S.4000000001", [1, 2])]


def test_bits_in_another_block_are_gathered(spark, tmp_path):
    """A file whose first block holds a bit of a query that the second lists."""
    path = tmp_path / "a.bin"
    head = container.encode_file_header_and_flags("S", ["x", "y"], 3)
    path.write_bytes(head + container.encode_block([0, 2, 4], [0, 1], ["a", "b"]) + container.encode_block([5], [2], ["c"]))
    got = container.read_container(spark, str(path)).records.orderBy("query_id").collect()
    assert [(r.query_id, r.query_name, r.ones) for r in got] == [(0, "a", [0]), (1, "b", [0]), (2, "c", [0, 1])]


def test_pruning_by_query(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    container.write_container(alignment(spark, [(i, f"q{i}", [0], i) for i in range(10)], ["x"]), path, block_size=2)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.query_name for r in container.read_view(spark, path).filter("query_id = 7").collect()] == ["q7"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_matches_batch(spark, tmp_path):
    from alnspark.streaming.text import read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("query_name\tx\ty\nr1\t1\t0\nr2\t0\t3\n")
    q = read_stream(spark, str(tmp_path / "in"), "bifrost").writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.query_name, r.ones) for r in spark.table("lines").collect()) == [("r1", [0]), ("r2", [1])]
