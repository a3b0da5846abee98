"""Dictionaries, ranks and containers at sizes where partitions differ, and files of the format itself."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alnspark import workspace
from alnspark.errors import HeaderPromiseNotHonoured, InvalidConversion, QueryIdsNotFilled, SetBitsNotSorted
from alnspark.functions.text_formats import parse, render
from alnspark.model import Alignment, dense_rank_by
from alnspark.operators import resolve
from alnspark.plans import api, cli
from alnspark.sources import container, layout
from alnspark.sources.text import read_fastx_names, read_names, target_table

# Files as the format defines them, five queries by two targets, hits 0 2 4 5 7.
HEAD = [97, 104, 100, 97, 0, 0]
NAMED = bytes([*HEAD, 0, 1, 3, 0, 2, 0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0, 1, 0, 51, 0, 0, 0, 0, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 227, 114, 13, 10, 50, 49, 48, 54, 53, 52, 50, 99, 226, 76, 206, 40, 210, 75, 75, 44, 46, 73, 228, 45, 200, 73, 44, 206, 205, 76, 129, 240, 0, 66, 30, 44, 81, 36, 0, 0, 0, 5, 0, 0, 0, 1, 0, 0, 0, 40, 0, 0, 0, 65, 0, 0, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 99, 100, 229, 113, 13, 10, 50, 49, 48, 54, 53, 52, 50, 211, 51, 68, 230, 24, 9, 34, 113, 204, 76, 13, 45, 13, 140, 249, 145, 68, 204, 77, 77, 140, 121, 145, 245, 154, 49, 178, 50, 48, 50, 49, 179, 0, 0, 22, 232, 102, 239, 83, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 179, 50, 96, 96, 96, 100, 0, 1, 22, 6, 1, 48, 205, 196, 192, 194, 192, 202, 192, 206, 0, 0, 47, 109, 177, 38, 26, 0, 0, 0])
UNNAMED = bytes([*HEAD, 0, 1, 2, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 51, 0, 0, 0, 0, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 227, 114, 13, 10, 50, 49, 48, 54, 53, 52, 50, 99, 226, 76, 206, 40, 210, 75, 75, 44, 46, 73, 228, 45, 200, 73, 44, 206, 205, 76, 129, 240, 0, 66, 30, 44, 81, 36, 0, 0, 0, 5, 0, 0, 0, 1, 0, 0, 0, 40, 0, 0, 0, 28, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 99, 96, 100, 101, 96, 100, 98, 102, 1, 0, 191, 97, 224, 4, 8, 0, 0, 0, 31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 179, 50, 96, 96, 96, 100, 0, 1, 22, 6, 1, 48, 205, 196, 192, 194, 192, 202, 192, 206, 0, 0, 47, 109, 177, 38, 26, 0, 0, 0])
TARGETS, SAMPLE = ["chr.fasta", "plasmid.fasta"], "ERR4035126"
NAMES = [f"{SAMPLE}.{i}" for i in (1, 2, 651903, 7543, 16)]
ONES = [[0], [0], [0, 1], [1], []]


@pytest.mark.parametrize("data, names", [(NAMED, NAMES), (UNNAMED, [f"{SAMPLE}.{i}" for i in range(1, 6)])])
def test_files_of_the_format_are_read(spark, tmp_path, data, names):
    path = tmp_path / "a"
    path.write_bytes(data)
    a = container.read_container(spark, str(path))
    got = a.records.orderBy("query_id").collect()
    assert [(r.query_id, r.query_name, r.ones) for r in got] == list(zip(range(5), names, ONES, strict=True))
    assert container.decode_target_names(str(path)) == TARGETS and a.sample == SAMPLE and container.info(str(path))["n_queries"] == 5
    assert sorted((r.query_id, r.target_id) for r in container.read_view(spark, str(path), "edges").collect()) == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 1)]


def test_files_of_the_format_are_written():
    """Headers and flags byte by byte, bitmaps once inflated, as their deflated form depends on the library."""
    assert NAMED.startswith(container.encode_file_header_and_flags(SAMPLE, TARGETS, 5))
    own = container.encode_block([0, 2, 4, 5, 7], list(range(5)), NAMES)
    block = NAMED[83:]
    assert own[:8] == block[:8] and own[12:97] == block[12:97]  # but for the length of the bitmap
    assert layout.inflate(own[97:]) == layout.inflate(block[97:])


def ranked_right(spark, rows, factor):
    out = dense_rank_by(rows, "k", "n")
    assert out.filter(f"n * {factor} <> k").isEmpty()
    return out.count()


@pytest.mark.parametrize("partitions", [4, 64])
@pytest.mark.parametrize("adaptive, coalesce", [("true", "true"), ("true", "false"), ("false", "false")])
def test_ranks_lose_no_row(spark, partitions, adaptive, coalesce):
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": adaptive,
           "spark.sql.adaptive.coalescePartitions.enabled": coalesce}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = spark.range(100_000).select((F.col("id") * 7).alias("k"), F.repeat(F.lit("x"), 60).alias("w")).repartition(5, "k")
        assert ranked_right(spark, rows, 7) == 100_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_of_real_size(spark, tmp_path):
    names = [f"read.{i * 7919 % 300_007}" for i in range(300_000)]
    (tmp_path / "names").write_text("\n".join(names) + "\n" + names[0] + "\n")
    (tmp_path / "reads.fq").write_text("".join(f"@{n} x\nAC\n+\n@@\n" for n in names[:50_000]) + "\n\n")
    for got, n in ((read_names(spark, str(tmp_path / "names"), "query"), 300_000), (read_fastx_names(spark, str(tmp_path / "reads.fq")), 50_000)):
        rows = got.toPandas().sort_values("query_id")
        assert rows.query_id.tolist() == list(range(n)) and rows.query_name.tolist() == names[:n]


def test_fastq_heads_are_checked(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\n\n+\n\n@r2 y\r\nAC\n+\nII\n")
    assert [r.query_name for r in read_fastx_names(spark, str(tmp_path / "a.fq")).orderBy("query_id").collect()] == ["r1", "r2"]
    (tmp_path / "b.fq").write_text("@r1\nAC\n+\nII\nr2\nAC\n+\nII\n")
    with pytest.raises(Exception, match="CorruptedInputErr"):
        read_fastx_names(spark, str(tmp_path / "b.fq")).collect()


def rows_of(spark, rows, targets):
    records = spark.createDataFrame(rows, "query_id long, query_name string, ones array<long>, row_idx long")
    return Alignment(records, target_table(spark, targets), None, "S")


def many(seed=3, n=3000, targets=40):
    rng = random.Random(seed)
    ids = rng.sample(range(n * 3), n)
    return [(q, f"q{q}", sorted(rng.sample(range(targets), rng.choice([0, 1, 2, 30]))), i) for i, q in enumerate(ids)]


def test_decode_keeps_every_line_in_order(spark, tmp_path):
    rows, targets = many(), [f"t{i}" for i in range(40)]
    container.write_container(rows_of(spark, rows, targets), str(tmp_path / "a"), block_size=700, by="row_idx", folder=True)
    api.decode(spark, str(tmp_path / "a"), str(tmp_path / "out"), "themisto")
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    expected = []
    for at in range(0, len(rows), 700):
        block = sorted(rows[at : at + 700])
        expected += [" ".join(map(str, [r[0], *r[2]])) for r in sorted(block, key=lambda r: (not r[2], r[0]))]
    assert got == expected


def test_blocks_are_bounded_by_hits_and_read_in_pieces(spark, tmp_path, monkeypatch):
    """Many blocks for few records, and batches that end inside a block; nothing is lost."""
    rows, targets = many(4, 400), [f"t{i}" for i in range(40)]
    block = layout.Block([r[0] for r in sorted(rows)], [r[1] for r in sorted(rows)],
                         np.array(sorted(r[0] * 40 + t for r in rows for t in r[2])), 0)
    monkeypatch.setattr(container, "BATCH_HITS", 50)
    raw = layout.inflate(layout.pack_bitmap(block.bits, 0))
    # small chunks, so that queries lie across them
    chunks = (c for part in layout.bitmap_chunks(raw, 0) for c in np.array_split(part, 70))
    got = [r for b in container._rows(chunks, 40, np.array(block.ids), block.names, 0) for r in b.to_pylist()]
    assert [(r["query_id"], r["query_name"], r["ones"]) for r in got] == [(q, n, o) for q, n, o, _ in sorted(rows)]
    packer = container._packer(40, 0, 100, layout.GZIP, True)
    monkeypatch.setattr(container, "MOST_HITS", 90)
    import pyarrow as pa

    table = pa.table({"block_id": pa.array([0] * len(rows), pa.int64()), "query_id": [r[0] for r in sorted(rows)],
                      "query_name": [r[1] for r in sorted(rows)], "ones": pa.array([r[2] for r in sorted(rows)], pa.list_(pa.int64()))})
    blocks = [layout.Block.unpack(r["data"]) for b in packer(iter(table.to_batches(max_chunksize=33))) for r in b.to_pylist()]
    assert all(len(b.ids) <= 100 and len(b.bits) < 90 + 30 for b in blocks) and len(blocks) > 20
    assert [i for b in blocks for i in b.ids] == block.ids and np.array_equal(np.concatenate([b.bits for b in blocks]), block.bits)


def test_folder_and_file_hold_the_same(spark, tmp_path):
    a = rows_of(spark, many(), [f"t{i}" for i in range(40)])
    container.write_container(a, str(tmp_path / "folder"), block_size=500, folder=True)
    container.join(str(tmp_path / "folder"), str(tmp_path / "joined"))
    container.write_container(a, str(tmp_path / "file"), block_size=500)
    assert (tmp_path / "joined").read_bytes() == (tmp_path / "file").read_bytes()
    views = [sorted(map(tuple, container.read_view(spark, str(tmp_path / x), "queries").select("query_id", "query_name").collect())) for x in ("folder", "file")]
    assert views[0] == views[1] == sorted((q, n) for q, n, _, _ in many())
    plan = container.read_container(spark, str(tmp_path / "file")).records._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # separate blocks are read without a shuffle


def test_cat_copies_blocks(spark, tmp_path):
    rows, targets = many(), [f"t{i}" for i in range(40)]
    for k in (0, 1):
        container.write_container(rows_of(spark, [r for r in rows if r[0] % 2 == k], targets), str(tmp_path / str(k)), compression=k, folder=bool(k))
    api.cat(spark, [str(tmp_path / "0"), str(tmp_path / "1")], str(tmp_path / "both"))
    got = container.read_container(spark, str(tmp_path / "both")).records.orderBy("query_id").collect()
    assert [(r.query_id, r.query_name, r.ones) for r in got] == [(q, n, o) for q, n, o, _ in sorted(rows)]
    assert {r.metadata_compression for _, r in container.walk_blocks(str(tmp_path / "both"))} == {layout.GZIP}


def test_names_given_to_the_writer(spark, tmp_path):
    a = rows_of(spark, [(0, "old", [0], 0), (1, None, [], 1)], ["x"])
    names = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, query_name string")
    container.write_container(a, str(tmp_path / "a"), query_names=names)
    assert container.decode_query_names(str(tmp_path / "a")) == ["a", "b"]


def test_bad_containers_and_bits(spark, tmp_path):
    with pytest.raises(SetBitsNotSorted):
        container.encode_block([2, 1], [0, 1])
    with pytest.raises(InvalidConversion):
        container.encode_block([1], [1 << 33])
    with pytest.raises(InvalidConversion):
        layout.pack_bitmap(np.array([1 << 33]), layout.BITS_32)
    with pytest.raises(QueryIdsNotFilled):
        container.write_container(rows_of(spark, [(None, "a", [0], 0)], ["x"]), str(tmp_path / "a"))
    data = bytearray(container.encode_block([0], [0], ["a"]))
    data[20] = layout.HAS_IDS  # the header forgets the names
    with pytest.raises(HeaderPromiseNotHonoured):
        layout.Block.unpack(bytes(data))


def test_ids_that_are_no_places(spark):
    targets = spark.createDataFrame([(0, "a"), (2, "c"), (3, "d")], "target_id long, target_name string")
    schema = "query_id long, query_name string, ones array<long>, ones_names array<string>"
    rows = spark.createDataFrame([(0, None, [2, 0, 3], None), (1, None, [], None), (2, None, None, None)], schema)
    got = resolve.fill_target_names(Alignment(rows, targets)).records.orderBy("query_id").collect()
    assert [r.ones_names for r in got] == [["c", "a", "d"], [], None]
    with pytest.raises(Exception, match="IndexNotFound"):
        resolve.fill_target_names(Alignment(spark.createDataFrame([(0, None, [1], None)], schema), targets)).records.collect()


def test_lines_are_split_once(spark):
    rows = spark.createDataFrame([("r\t16\ta\t1",)], "value string")
    plan = parse(rows, "sam")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_wide_cells(spark):
    schema = "query_id long, query_name string, ones array<long>, ones_names array<string>"
    rows = spark.createDataFrame([(0, "r", [4, 0, 4, 9], None), (1, "s", [], None)], schema)
    got = [r.v for r in rows.select(render("bifrost", 6).alias("v"), "query_id").orderBy("query_id").collect()]
    assert got == ["r\t1\t0\t0\t0\t1\t0", "s\t0\t0\t0\t0\t0\t0"]
    assert rows.select(render("tsv", 1).alias("v")).filter("v like '1%'").first().v == "1\ts\t0"


class Terminal(io.BytesIO):
    def isatty(self):
        return True


def test_pipes(spark, tmp_path):
    (tmp_path / "t").write_text("x\ny\n")
    out = io.BytesIO()
    cli.main(["encode", "-", "-t", str(tmp_path / "t")], spark, io.BytesIO(b"3 1\n0 0 1\n"), out)
    (tmp_path / "a").write_bytes(out.getvalue())
    lines = io.BytesIO()
    cli.main(["decode", "-", "-F", "themisto"], spark, io.BytesIO(out.getvalue()), lines)
    assert lines.getvalue() == b"0 0 1\n3 1\n"
    same = io.BytesIO()
    cli.main(["set", "union", str(tmp_path / "a"), str(tmp_path / "a")], spark, None, same)
    (tmp_path / "b").write_bytes(same.getvalue())
    assert sorted(map(tuple, container.read_view(spark, str(tmp_path / "b"), "edges").collect())) == [(0, 0), (0, 1), (3, 1)]
    with pytest.raises(SystemExit):
        cli.main(["cat", str(tmp_path / "a")], spark, None, Terminal())
    forced = Terminal()
    cli.main(["cat", str(tmp_path / "a"), "--force"], spark, None, forced)
    assert forced.getvalue()[:4] == bytes(HEAD[:4])


def test_shared_folder(spark, tmp_path):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_path(Session(), "x")
    written = workspace.materialize(spark.range(3), "kept")
    assert written.count() == 3 and workspace.clean_up(spark) >= 1
    with pytest.raises(Exception):
        written.count()
