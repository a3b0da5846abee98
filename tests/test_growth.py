"""What a step costs follows its input: steps counted, where a time would depend on the machine."""

import numpy as np
from pyspark.sql import functions as F

from alnspark.model import Alignment, dense_places
from alnspark.operators import matrix, resolve
from alnspark.plans import api
from alnspark.sources import container, layout
from alnspark.sources import text as sources_text
from alnspark.sources.text import first_line, target_table


def test_sparse_bitmaps_come_in_large_chunks():
    """As many keys as numbers, as where there are more targets than 65,536 for few hits."""
    for kind, step in ((layout.BITS_32, 1 << 15), (layout.BITS_64, 1 << 21)):
        bits = np.arange(100_000, dtype=np.int64) * step
        raw = layout.inflate(layout.pack_bitmap(bits, kind))
        chunks = list(layout.bitmap_chunks(raw, kind))
        assert len(chunks) <= 4 and max(map(len, chunks)) <= 1 << 16 and np.array_equal(np.concatenate(chunks), bits)


def test_small_blocks_share_a_task_and_names_of_targets_are_read_once(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query_name"), F.array(F.col("id") % 7).alias("ones"))
    a = Alignment(rows, target_table(spark, [f"t{i}" for i in range(7)]), None, "S")
    for folder in (False, True):
        path = str(tmp_path / f"a{folder}")
        container.write_container(a, path, block_size=10, folder=folder)
        reader = container.ContainerReader(path, "index")
        parts = reader.partitions()
        assert len(parts) <= 20 and sum(len(p.blocks) for p in parts) == 200
        with monkeypatch.context() as m:
            m.setattr(layout, "read_file_flags", None)
            got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["block_id"], r["num_records"], r["first_id"], r["foreign"]) for r in got] == [(i, 10, 10 * i, 0) for i in range(200)]
        assert container.read_container(spark, path).records.filter("ones[0] = query_id % 7 and query_name = concat('q', query_id)").count() == 2000


def test_bits_of_other_blocks_are_counted():
    ids = np.array([2, 5, 9])
    assert container._foreign(np.array([1, 2, 2, 5, 6, 9, 10]), ids) == 3 and container._foreign(np.array([1, 2]), ids[:0]) == 2


def test_encoding_makes_no_join_that_fills_nothing(spark, tmp_path, monkeypatch):
    """Lines with ids only, in input order without gaps: names are looked up, nothing else is."""
    (tmp_path / "lines").write_text("".join(f"{i} {i % 5} {i % 3}\n" for i in range(300)))
    (tmp_path / "named").write_text("".join(f"q{i}\t1\t{i % 5}\n" for i in range(300)))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query_name"))
    targets = target_table(spark, [f"t{i}" for i in range(5)])
    done = []
    for module, name in ((resolve, "fill_query_ids"), (resolve, "fill_query_names"), (resolve, "fill_target_ids"), (matrix, "collapse"), (container, "dense_rank_by")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **b: (done.append(n), f(*a, **b))[1])
    for source, expected in (("lines", ["fill_query_names"]), ("named", ["fill_query_ids"])):
        done.clear()
        api.encode(spark, str(tmp_path / source), str(tmp_path / f"{source}.pa"), targets, queries, "S")
        assert done == expected
        got = container.read_container(spark, str(tmp_path / f"{source}.pa")).records.orderBy("query_id").collect()
        assert [(r.query_id, r.query_name) for r in got] == [(i, f"q{i}") for i in range(300)]
        assert [r.ones for r in got] == [sorted({i % 5, i % 3} if source == "lines" else {i % 5}) for i in range(300)]


def test_decoding_looks_nothing_up_that_it_has(spark, tmp_path, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query_name"), F.array(F.col("id") % 7).alias("ones"))
    container.write_container(Alignment(rows, target_table(spark, [f"t{i}" for i in range(7)]), None, "S"), str(tmp_path / "a"))
    monkeypatch.setattr(resolve, "fill_target_ids", None)
    for fmt, line in (("themisto", "8 1"), ("metagraph", "8\tq8\tt1"), ("bifrost", "q8\t0\t1\t0\t0\t0\t0\t0")):
        api.decode(spark, str(tmp_path / "a"), str(tmp_path / fmt), fmt)
        assert line in [r.value for r in spark.read.text(str(tmp_path / fmt)).collect()]


def test_repeated_records_and_gaps(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "query_id long")

    assert not matrix.repeated(ids(1, 2, None)) and matrix.repeated(ids(1, 2, 1)) and matrix.repeated(ids(1, None, None)) and not matrix.repeated(ids())
    assert dense_places(ids(4, 6), "query_id") is None and dense_places(ids(4, None), "query_id") is None
    for values in ((5, 4, 6), ()):
        rows = ids(*values)
        assert sorted(r.p for r in rows.select(dense_places(rows, "query_id").alias("p")).collect()) == list(range(len(values)))


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    """Joined by shuffle, as beside a large dictionary; they match nothing, whatever they are dealt by."""
    schema = "query_id long, query_name string, ones array<long>, ones_names array<string>"
    rows = spark.createDataFrame([(i, None, [], None) for i in range(400)] + [(None, "q5", [], None)], schema)
    queries = spark.range(400).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query_name"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    small, resolve.BROADCAST_BYTES = resolve.BROADCAST_BYTES, 0
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = resolve.fill_query_ids(Alignment(rows, None, queries)).records
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 300
        assert sorted(r.query_id for r in out.collect()) == sorted([*range(400), 5])
    finally:
        resolve.BROADCAST_BYTES = small
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_first_line_is_that_of_the_first_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for name, text in (("a b", ""), ("b c", "one\ntwo\n"), ("c", "x\n")):
        (tmp_path / "in" / name).write_text(text)
    seen = []
    monkeypatch.setattr(sources_text, "lines", lambda *a, f=sources_text.lines: (seen.append(1), f(*a))[1])
    assert first_line(spark, str(tmp_path / "in")) == "one" and len(seen) <= 2
    (tmp_path / "none").write_text("")
    assert first_line(spark, str(tmp_path / "none")) == ""
