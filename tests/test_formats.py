import warnings

import pytest
from pyspark.sql import functions as F

from alnspark.errors import AmbiguousInputFormatErr, NeedTargetSequences, UnrecognizedInputFormatErr
from alnspark.functions.sniff import sniff
from alnspark.functions.text_formats import header_lines, parse, render
from alnspark.model import Alignment
from alnspark.operators import matrix, resolve, set_ops
from alnspark.operators.concat import concatenate
from alnspark.plans import api, cli
from alnspark.sources.text import read_alignment, read_fastx_names, read_names, target_table


def parsed(spark, fmt, *lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = parse(rows, fmt, keep=["i"]).orderBy("i").collect()
    return [(r.query_id, r.query_name, r.ones, r.ones_names) for r in got]


def test_sniff():
    cases = {"@HD\tVN:1.6": "sam", "": "themisto", "8 1": "themisto", "query_name\tx": "bifrost", "query_index\tquery_name": "tsv",
             "r1\t2\t0\t1": "fulgor", "3\tr1\ta:b": "metagraph"}
    assert {k: sniff(k) for k in cases} == cases
    with pytest.raises(AmbiguousInputFormatErr):
        sniff("11301\t0")
    with pytest.raises(UnrecognizedInputFormatErr):
        sniff("a\tb")


def test_parse_each_format(spark):
    assert parsed(spark, "themisto", "128 0 7 11 3", "8") == [(128, None, [0, 7, 11, 3], None), (8, None, [], None)]
    assert parsed(spark, "fulgor", "r.1\t0", "r.2\t9\t0\t1") == [(None, "r.1", [], None), (None, "r.2", [0, 1], None)]
    assert parsed(spark, "bifrost", "r.1\t67\t0\t+2", "r.2") == [(None, "r.1", [0, 2], None), (None, "r.2", [], None)]
    assert parsed(spark, "metagraph", "5\tr.1\ta::b", "30\tr.2\t") == [(5, "r.1", None, ["a", "b"]), (30, "r.2", None, [])]
    assert parsed(spark, "tsv", "5\tr.1\t1\t0") == [(5, "r.1", [0], None)]
    assert parsed(spark, "sam", "r\t16\ta\t1", "r\t77\t*\t0") == [(None, "r", None, ["a"]), (None, "r", None, None)]


@pytest.mark.parametrize(
    "fmt,line,error",
    [("themisto", "8 1 ", "CorruptedInputErr"), ("themisto", "4294967296", "CorruptedInputErr"), ("themisto", " 5", "CorruptedInputErr"),
     ("fulgor", "r", "CorruptedInputErr"), ("bifrost", "query_name\tx", "HeaderNotConsumedError"), ("sam", "r\t0\t*", "CorruptedInputErr")],
)
def test_bad_lines_stop(spark, fmt, line, error):
    with pytest.raises(Exception, match=error):
        parsed(spark, fmt, line)


def test_render_and_missing_fields(spark):
    rows = spark.createDataFrame([(3, "r", [2, 0], ["c", "a"])], "query_id long, query_name string, ones array<long>, ones_names array<string>")
    lines = {f: rows.select(render(f, 3).alias("v")).first().v for f in ("themisto", "fulgor", "bifrost", "metagraph", "tsv")}
    assert lines == {"themisto": "3 2 0", "fulgor": "r\t2\t2\t0", "bifrost": "r\t1\t0\t1", "metagraph": "3\tr\tc:a", "tsv": "3\tr\t1\t0\t1"}
    with pytest.raises(Exception, match="FieldMissing"):
        rows.withColumn("query_id", F.lit(None).cast("long")).select(render("themisto")).collect()
    with pytest.raises(NotImplementedError):
        render("sam")
    assert header_lines("sam", ["x"]) == ["@HD\tVN:1.6", "@SQ\tSN:x\tLN:1"]


@pytest.fixture
def names(tmp_path):
    (tmp_path / "t").write_text("chr.fasta\nplasmid.fasta\nchr.fasta\n")
    (tmp_path / "q.fa").write_text(">r1 extra\nACGT\n>r2\nAC\n>r651903\nA\n>r7543\nA\n>r16\nA\n")
    return str(tmp_path / "t"), str(tmp_path / "q.fa")


def test_dictionaries_rank_first_occurrence(spark, names):
    assert [tuple(r) for r in read_names(spark, names[0], "target").orderBy("target_id").collect()] == [(0, "chr.fasta"), (1, "plasmid.fasta")]
    assert [r[1] for r in read_fastx_names(spark, names[1]).orderBy("query_id").collect()] == ["r1", "r2", "r651903", "r7543", "r16"]


def test_convert_keeps_order(spark, names, tmp_path):
    (tmp_path / "in").write_text("1\tr2\tchr.fasta\n0\tr1\tchr.fasta\n2\tr651903\tplasmid.fasta:chr.fasta\n4\tr16\t\n")
    a = read_alignment(spark, str(tmp_path / "in"), targets=read_names(spark, names[0], "target"))
    lines = api.converted(a, "themisto").records.orderBy("row_idx").select(render("themisto").alias("v"))
    assert [r.v for r in lines.collect()] == ["1 0", "0 0", "2 1 0", "4"]
    api.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), "bifrost", read_names(spark, names[0], "target"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert got == "query_name\tchr.fasta\tplasmid.fasta\nr2\t1\t0\nr1\t1\t0\nr651903\t1\t1\nr16\t0\t0\n"
    (tmp_path / "th").write_text("0 1\n")
    with pytest.raises(NeedTargetSequences):
        read_alignment(spark, str(tmp_path / "th"))


def test_strict_lookups(spark):
    targets = target_table(spark, ["a", "b"])
    rows = spark.createDataFrame([(0, None, [5], None)], "query_id long, query_name string, ones array<long>, ones_names array<string>")
    with pytest.raises(Exception, match="IndexNotFound"):
        resolve.fill_target_names(Alignment(rows, targets)).records.collect()
    rows = spark.createDataFrame([(0, None, None, ["z"])], rows.schema)
    with pytest.raises(Exception, match="KeyNotFound"):
        resolve.fill_target_ids(Alignment(rows, targets)).records.collect()


def test_names_to_ids_keeps_null_empty_order_and_repeats(spark):
    schema = "query_id long, query_name string, ones array<long>, ones_names array<string>"
    rows = spark.createDataFrame([(0, None, None, ["b", "a", "b"]), (1, None, None, []), (2, None, None, None)], schema)
    got = resolve.fill_target_ids(Alignment(rows, target_table(spark, ["a", "b"]))).records.orderBy("query_id").collect()
    assert [r.ones for r in got] == [[1, 0, 1], [], None]


def _bits(spark, *values):
    return matrix.from_bits(spark.createDataFrame([(v,) for v in values], "bit long"), 2)


@pytest.mark.parametrize(
    "op,left,expected",
    [("union", {1, 5, 8}, {0, 1, 2, 4, 5, 7, 8}), ("intersection", {0, 3, 7}, {0, 7}), ("xor", {0, 1, 5, 7}, {1, 2, 4}),
     ("diff", {0, 2, 3, 4, 5, 6, 7}, {3, 6})],
)
def test_set_operations(spark, op, left, expected):
    out = set_ops.combine([_bits(spark, *left), _bits(spark, 0, 2, 4, 5, 7)], op)
    assert {r.bit for r in matrix.bits(out, 2).collect()} == expected


def test_many_inputs_and_universe(spark):
    inputs = [_bits(spark, 0, 2)] * 64
    assert {r.bit for r in matrix.bits(set_ops.combine(inputs, "intersection"), 2).collect()} == {0, 2}
    assert set_ops.combine(inputs, "xor").count() == 0
    queries = spark.createDataFrame([(0, "a"), (3, "d")], "query_id long, query_name string")
    first = set_ops.combine_records([_bits(spark, 0, 2)], "union", queries).orderBy("query_id").collect()
    assert [(r.query_id, r.ones) for r in first] == [(0, [0]), (3, [])]
    assert set_ops.combine_records([_bits(spark, 0, 2)], "union", queries, "all").count() == 3


def test_concatenate_checks(spark):
    def a(ids, targets=("x", "y")):
        rows = spark.createDataFrame([(i, [0]) for i in ids], "query_id long, ones array<long>")
        return Alignment(rows, target_table(spark, list(targets)))

    assert concatenate([a([0, 1]), a([2])]).records.count() == 3
    with pytest.raises(Exception, match="more than once"):
        concatenate([a([0, 1]), a([1])])
    with pytest.raises(Exception, match="different targets"):
        concatenate([a([0]), a([1], ("x", "z"))])


def test_command_line_round_trip(spark, names, tmp_path):
    (tmp_path / "in").write_text("1 0\n0 0\n2 0 1\n4\n3 1\n")
    one = str(tmp_path / "one.bin")
    cli.main(["encode", str(tmp_path / "in"), "-o", one, "-q", names[1], "-t", names[0], "--sample", "S", "--block-size", "2"], spark)
    cli.main(["set", "intersection", one, one, "-o", str(tmp_path / "two.bin")], spark)
    cli.main(["decode", str(tmp_path / "two.bin"), "-o", str(tmp_path / "out"), "-F", "metagraph"], spark)
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert sorted(got) == ["0\tr1\tchr.fasta", "1\tr2\tchr.fasta", "2\tr651903\tchr.fasta:plasmid.fasta", "3\tr7543\tplasmid.fasta", "4\tr16\t"]
    with pytest.raises(Exception, match="more than once"):
        cli.main(["cat", one, one, "-o", str(tmp_path / "three.bin")], spark)


def test_a_late_difference_from_the_header_warns(spark, tmp_path):
    own = [f"t{i}" for i in range(1002)]
    (tmp_path / "in").write_text("\t".join(["query_name", *own]) + "\n" + "\t".join(["r1", *["0"] * 1002]) + "\n")
    for last, warned in (("t1001", 0), ("other", 1)):
        (tmp_path / "names").write_text("\n".join([*own[:-1], last]) + "\n")
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            read_alignment(spark, str(tmp_path / "in"), targets=read_names(spark, str(tmp_path / "names"), "target"))
        assert sum("differ from the header" in str(w.message) for w in seen) == warned
