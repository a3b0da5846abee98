"""Registered queries of the engine, and SQL that gives the same rows.

Two alignments are read from the tables.  SUP: orders are queries, suppliers targets, a line item
makes a hit; its three samples are the return flags.  EVT: users are queries, event types targets,
and event counts stand for k-mer counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sniff import sniff_column
from .functions.text_formats import header_lines, parse, render
from .errors import AlignmentError
from .model import Alignment, dense_rank_by, dictionary
from .operators import concat, matrix, resolve, set_ops
from .plans import api, cli
from .sources import container, text
from .streaming.text import read_stream, render_stream, unique_edges
from .workspace import materialize, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sup_edges(spark, sf_dir, flag: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    if flag:
        rows = rows.filter(F.col("l_returnflag") == flag)
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("target_id"))


def sup_targets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("target_id"), F.col("s_name").alias("target_name"))


def sup_queries(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(key.alias("query_id"), F.concat(F.lit("order."), key + 1).alias("query_name"))


def sup(spark, sf_dir, flag: str | None = None) -> Alignment:
    queries = sup_queries(spark, sf_dir)
    records = matrix.pad(matrix.regroup(sup_edges(spark, sf_dir, flag)), queries)
    records = records.withColumn("ones_names", F.lit(None).cast("array<string>"))
    return Alignment(records, sup_targets(spark, sf_dir), queries, "S")


def evt(spark, sf_dir) -> Alignment:
    """Users by event types, all users listed."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct()
    targets = dictionary(types, "event_type", "event_type", "target")
    user = F.col("user_id").cast("long")
    users = events.select(user.alias("query_id"), F.concat(F.lit("user."), user + 1).alias("query_name")).distinct()
    hits = events.select(user.alias("query_id"), "event_type").distinct().join(
        F.broadcast(targets) if resolve.small(targets) else targets, F.col("event_type") == F.col("target_name"))
    records = matrix.pad(matrix.regroup(hits), users).withColumn("ones_names", F.lit(None).cast("array<string>"))
    return Alignment(records, targets, users, "E")


def shown(records: DataFrame, *columns: str) -> DataFrame:
    return records.select(*columns, F.array_join("ones", " ").alias("ones"))


EDGES = "(select distinct cast(l_orderkey as bigint) q, cast(l_suppkey as bigint) t from lineitem)"
ONES = "coalesce(string_agg(cast(t as varchar), ' ' order by t), '')"
NAME = "'order.' || cast(o_orderkey + 1 as varchar)"
CELLS = (
    "(select u, 'user.' || cast(u + 1 as varchar) as name, string_agg(case when c > 0 then '1' else '0' end, chr(9) order by k) as cells from "
    "(select us.u as u, ty.k as k, count(ev.user_id) as c from (select distinct cast(user_id as bigint) u from events) us "
    "cross join (select distinct event_type k from events) ty left join events ev on ev.user_id = us.u and ev.event_type = ty.k "
    "group by us.u, ty.k) x group by u)"
)
TYPES = "(select event_type as k, row_number() over (order by event_type) - 1 as t from (select distinct event_type from events) d)"
EVT_EDGES = f"(select distinct cast(e.user_id as bigint) q, cast(y.t as bigint) t from events e join {TYPES} y on y.k = e.event_type)"


@register("flatten_bits", f"select q * (select count(*) from supplier) + t as bit from {EDGES} e")
def flatten_bits(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").count()
    return matrix.bits(sup_edges(spark, sf_dir).distinct(), n)


@register("unflatten_records", f"select q as query_id, {ONES} as ones from {EDGES} e group by q")
def unflatten_records(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").count()
    return shown(matrix.regroup(matrix.from_bits(matrix.bits(sup_edges(spark, sf_dir), n), n)), "query_id")


@register("hit_counts", f"select q as query_id, count(*) as hits from {EDGES} e group by q")
def hit_counts(spark, sf_dir):
    return sup_edges(spark, sf_dir).groupBy("query_id").agg(F.count_distinct("target_id").alias("hits"))


PADDED = "select cast(o_orderkey as bigint) as query_id, {name} as query_name, {ones} as ones from orders left join {edges} e on q = o_orderkey group by o_orderkey"


@register("pad_unaligned", PADDED.format(name=NAME, ones=ONES, edges=EDGES))
def pad_unaligned(spark, sf_dir):
    return shown(sup(spark, sf_dir).records, "query_id", "query_name")


def _sets() -> None:
    tagged = "(select distinct cast(l_orderkey as bigint) q, cast(l_suppkey as bigint) t, l_returnflag f from lineitem where l_returnflag in ({flags}))"
    having = {"union": "true", "intersection": "count(*) = {k}", "xor": "count(*) % 2 = 1", "diff": "min(f) = 'A' and count(*) = 1"}
    for op in set_ops.OPERATIONS:
        for flags in ("ANR", "AN"):
            source = tagged.format(flags=", ".join(f"'{f}'" for f in flags))
            found = f"(select q, t from {source} x group by q, t having {having[op].format(k=len(flags))})"

            def pairs(spark, sf_dir, op=op, flags=flags):
                return set_ops.combine([sup_edges(spark, sf_dir, f) for f in flags], op)

            def records(spark, sf_dir, op=op, flags=flags):
                inputs = [sup_edges(spark, sf_dir, f) for f in flags]
                return shown(set_ops.combine_records(inputs, op, sup_queries(spark, sf_dir)), "query_id", "query_name")

            register(f"set_{op}_{len(flags)}", f"select q as query_id, t as target_id from {found} e")(pairs)
            if len(flags) == 3:
                register(f"set_{op}_records", PADDED.format(name=NAME, ones=ONES, edges=found))(records)


_sets()


@register("concat_disjoint", f"select q as query_id, {ONES} as ones from {EDGES} e group by q")
def concat_disjoint(spark, sf_dir):
    records = matrix.regroup(sup_edges(spark, sf_dir))
    parts = [Alignment(records.filter(F.col("query_id") % 2 == i), sup_targets(spark, sf_dir)) for i in (0, 1)]
    return shown(concat.concatenate(parts).records, "query_id")


@register("concat_duplicates", """select q as query_id, count(*) as n from (
    select distinct cast(l_orderkey as bigint) q, l_returnflag from lineitem) x group by q having count(*) > 1""")
def concat_duplicates(spark, sf_dir):
    parts = [matrix.regroup(sup_edges(spark, sf_dir, f)).select("query_id") for f in "ANR"]
    return concat.duplicates(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _rendered(spark, sf_dir, fmt: str) -> DataFrame:
    """Lines of SUP in a narrow format, of EVT in a wide one."""
    a = evt(spark, sf_dir) if fmt in ("bifrost", "tsv") else sup(spark, sf_dir)
    a = resolve.fill_target_names(a) if fmt == "metagraph" else a
    return a.records.select(render(fmt, a.targets.count()).alias("value"))


NAMES = f"(select q, string_agg(s_name, ':' order by t) as names from {EDGES} e join supplier on s_suppkey = t group by q)"
LINES = {
    "themisto": f"select cast(o_orderkey as varchar) || coalesce(' ' || string_agg(cast(t as varchar), ' ' order by t), '') as value "
                f"from orders left join {EDGES} e on q = o_orderkey group by o_orderkey",
    "fulgor": f"select {NAME} || chr(9) || cast(count(t) as varchar) || coalesce(chr(9) || string_agg(cast(t as varchar), chr(9) order by t), '') as value "
              f"from orders left join {EDGES} e on q = o_orderkey group by o_orderkey",
    "metagraph": f"select cast(o_orderkey as varchar) || chr(9) || {NAME} || chr(9) || coalesce(names, '') as value "
                 f"from orders left join {NAMES} e on q = o_orderkey",
    "bifrost": f"select name || chr(9) || cells as value from {CELLS} c",
    "tsv": f"select cast(u as varchar) || chr(9) || name || chr(9) || cells as value from {CELLS} c",
}


def _formats() -> None:
    for fmt, sql in LINES.items():
        register(f"render_{fmt}", sql)(lambda spark, sf_dir, fmt=fmt: _rendered(spark, sf_dir, fmt))

        def roundtrip(spark, sf_dir, fmt=fmt):
            a = evt(spark, sf_dir) if fmt in ("bifrost", "tsv") else sup(spark, sf_dir)
            records = parse(_rendered(spark, sf_dir, fmt), fmt)
            back = resolve.fill(Alignment(records, a.targets, a.queries), ["query_id", "ones"])
            return matrix.edges(back.records)

        source = EVT_EDGES if fmt in ("bifrost", "tsv") else EDGES
        register(f"roundtrip_{fmt}", f"select q as query_id, t as target_id from {source} e")(roundtrip)


_formats()


def _conversions() -> None:
    def convert(spark, sf_dir, a, b):
        base = evt(spark, sf_dir) if a in ("bifrost", "tsv") or b in ("bifrost", "tsv") else sup(spark, sf_dir)
        own = resolve.fill_target_names(base) if a == "metagraph" else base
        n = base.targets.count()
        records = parse(own.records.select(render(a, n).alias("value")), a)
        out = api.converted(Alignment(records, base.targets, base.queries), b)
        return out.records.select(render(b, n).alias("value"))

    evt_lines = {
        "bifrost": LINES["bifrost"], "tsv": LINES["tsv"],
        "fulgor": f"select 'user.' || cast(u + 1 as varchar) || chr(9) || cast(count(t) as varchar) || chr(9) || string_agg(cast(t as varchar), chr(9) order by t) as value "
                  f"from (select q as u, t from {EVT_EDGES} e) x group by u",
    }
    for a, b in (("themisto", "metagraph"), ("metagraph", "themisto"), ("fulgor", "themisto"), ("themisto", "fulgor"),
                 ("metagraph", "bifrost"), ("bifrost", "tsv"), ("tsv", "fulgor")):
        wide = {a, b} & {"bifrost", "tsv"}
        sql = evt_lines[b] if wide else LINES[b]
        register(f"convert_{a}_to_{b}", sql)(lambda spark, sf_dir, a=a, b=b: convert(spark, sf_dir, a, b))


_conversions()


@register("resolve_names_to_ids", f"select distinct q as query_id, t as target_id from {EDGES} e")
def resolve_names_to_ids(spark, sf_dir):
    named = resolve.fill_target_names(sup(spark, sf_dir))
    bare = named.records.withColumn("ones", F.lit(None).cast("array<bigint>")).withColumn("query_id", F.lit(None).cast("long"))
    return matrix.edges(resolve.fill_target_ids(resolve.fill_query_ids(named.with_records(bare))).records)


@register("resolve_ids_to_names", f"select {NAME} as query_name, s_name as target_name from {EDGES} e join orders on o_orderkey = q join supplier on s_suppkey = t")
def resolve_ids_to_names(spark, sf_dir):
    a = sup(spark, sf_dir)
    a = a.with_records(matrix.regroup(sup_edges(spark, sf_dir)).select(
        "query_id", F.lit(None).cast("string").alias("query_name"), "ones", F.lit(None).cast("array<string>").alias("ones_names")))
    out = resolve.fill_target_names(resolve.fill_query_names(a)).records
    return out.select("query_name", F.explode("ones_names").alias("target_name"))


@register("kmer_threshold", f"select u as query_id, cells from {CELLS} c")
def kmer_threshold(spark, sf_dir):
    """Counts become hits when they are above zero; every count is written out, then parsed."""
    a = evt(spark, sf_dir)
    grid = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("query_id"), "event_type").count()
    per_user = grid.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    names = a.targets.agg(F.array_sort(F.collect_list("target_name")).alias("l"))
    line = F.concat_ws("\t", F.concat(F.lit("user."), F.col("query_id") + 1),
                       F.array_join(F.transform(F.col("l"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("string")), "\t"))
    rows = per_user.withColumn("l", names.scalar()).select("query_id", line.alias("value"), F.size("l").alias("n"))
    parsed = parse(rows.withColumnRenamed("query_id", "user"), "bifrost", keep=["user", "n"])
    cells = render("bifrost", F.col("n")).alias("line")
    shown_cells = F.expr("substring(line, length(query_name) + 2)").alias("cells")
    return parsed.select(F.col("user").alias("query_id"), "query_name", cells).select("query_id", shown_cells)


@register("rename_queries", "select cast(o_orderkey as bigint) as query_id, 'S' || cast(row_number() over (order by o_orderkey) as varchar) as query_name from orders")
def rename_queries(spark, sf_dir):
    rows = dense_rank_by(sup_queries(spark, sf_dir).withColumn("place", F.col("query_id")), "place", "row_idx")
    return resolve.rename_queries(rows, "S").select("query_id", "query_name")


@register("fallback_names", "select cast(o_orderkey as bigint) as query_id, 'S.' || cast(o_orderkey + 1 as varchar) as query_name from orders")
def fallback_names(spark, sf_dir):
    a = sup(spark, sf_dir)
    bare = Alignment(a.records.withColumn("query_name", F.lit(None).cast("string")), a.targets, None, "S")
    return resolve.fill_query_names(bare, fallback=True).records.select("query_id", "query_name")


@register("strip_names", "select cast(o_orderkey as bigint) as query_id, cast(null as varchar) as query_name from orders")
def strip_names(spark, sf_dir):
    return resolve.strip_names(sup(spark, sf_dir).records).select("query_id", "query_name")


@register("collapse_records", f"select q as query_id, {ONES} as ones from {EDGES} e group by q")
def collapse_records(spark, sf_dir):
    rows = sup_edges(spark, sf_dir).select("query_id", F.lit(None).cast("string").alias("query_name"), F.array("target_id").alias("ones"))
    return shown(matrix.collapse(rows), "query_id")


@register("target_dictionary", f"select cast(t as bigint) as target_id, k as target_name from {TYPES} y")
def target_dictionary(spark, sf_dir):
    return evt(spark, sf_dir).targets


@register("sniff_format", """select * from (values
    ('@HD', 'sam'), ('8', 'themisto'), ('query_name chr', 'bifrost'), ('query_index query_name chr', 'tsv'),
    ('11301 0', 'ambiguous'), ('read.1 2 0 1', 'fulgor'), ('13 read.1 chr:plasmid', 'metagraph'), ('a b', 'unknown')) v(line, format)""")
def sniff_format(spark, sf_dir):
    lines = ["@HD", "8", "query_name chr", "query_index query_name chr", "11301 0", "read.1 2 0 1", "13 read.1 chr:plasmid", "a b"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    return rows.select("line", sniff_column(F.replace("line", F.lit(" "), F.lit("\t"))).alias("format"))


@register("parse_sam", """select 'order.' || cast(l_orderkey + 1 as varchar) as query_name,
    case when l_returnflag = 'R' then null else s_name end as target_name from lineitem join supplier on s_suppkey = l_suppkey""")
def parse_sam(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lost = F.col("l_returnflag") == "R"
    line = F.concat_ws("\t", F.concat(F.lit("order."), F.col("l_orderkey") + 1), F.when(lost, "4").otherwise("16"),
                       F.when(lost, "*").otherwise(F.col("s_name")), F.lit("1"))
    parsed = parse(rows, "sam", line)
    return parsed.select("query_name", F.explode_outer("ones_names").alias("target_name"))


@register("container_roundtrip", f"select q as query_id, t as target_id from {EDGES} e")
def container_roundtrip(spark, sf_dir):
    path = shared_path(spark, "container")
    container.write_container(sup(spark, sf_dir), path, block_size=4096)
    return container.read_view(spark, path, "edges")


@register("container_block_index", """select cast(o_orderkey // 4096 as bigint) as block_id, count(*) as num_records, min(cast(o_orderkey as bigint)) as first_id,
    max(cast(o_orderkey as bigint)) as last_id from orders group by 1""")
def container_block_index(spark, sf_dir):
    path = shared_path(spark, "container")
    container.write_container(sup(spark, sf_dir), path, block_size=4096)
    return container.read_view(spark, path, "index").select("block_id", "num_records", "first_id", "last_id")


@register("container_records", PADDED.format(name=NAME, ones=ONES, edges=EDGES))
def container_records(spark, sf_dir):
    path = shared_path(spark, "container")
    container.write_container(sup(spark, sf_dir), path)
    return shown(container.read_container(spark, path).records, "query_id", "query_name")


def _merged(operation: str):
    def run(spark, sf_dir):
        paths = []
        for flag in "ANR":
            paths.append(shared_path(spark, f"container-{flag}"))
            container.write_container(sup(spark, sf_dir, flag), paths[-1])
        out = shared_path(spark, "merged")
        api.merge(spark, paths, out, operation)
        return shown(container.read_container(spark, out).records, "query_id", "query_name")

    return run


for _op in ("union", "diff"):
    register(f"container_set_{_op}", ORACLE_SQL[f"set_{_op}_records"])(_merged(_op))


@register("container_cat", PADDED.format(name=NAME, ones=ONES, edges=EDGES))
def container_cat(spark, sf_dir):
    whole, paths = sup(spark, sf_dir), []
    for i in (0, 1):
        paths.append(shared_path(spark, f"container-{i}"))
        container.write_container(whole.with_records(whole.records.filter(F.col("query_id") % 2 == i)), paths[-1])
    out = shared_path(spark, "cat")
    api.cat(spark, paths, out)
    return shown(container.read_container(spark, out).records, "query_id", "query_name")


@register("stream_parse", f"select q as query_id, t as target_id from {EDGES} e")
def stream_parse(spark, sf_dir):
    """Lines of files through a stream, with its result written as Parquet."""
    source, out, state = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    _rendered(spark, sf_dir, "themisto").write.text(source)
    records = read_stream(spark, source, "themisto")
    pairs = records.select("query_id", F.explode("ones").alias("target_id"))
    query = pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


# Queries over files: texts rendered from the tables are written out and go through the public functions.


class Files:
    """SUP as files in the shared folder: lines of a format in order of the ids, names of targets and
    reads, and what is made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return shared_path(self.spark, name)

    def write(self, rows: DataFrame, name: str, head: list[str] | None = None) -> str:
        """Rows (place, value) as a folder of parts in order, after the lines of ``head``.  Bounds of the
        parts come from a first evaluation, so rows that cost much should be read from a table."""
        path = self.path(name)
        if head:
            first = self.spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "place long, value string")
            rows = first.unionByName(rows)
        rows.repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)
        return path

    def lines(self, fmt: str, flag: str | None = None, odd: int | None = None) -> str:
        a = sup(self.spark, self.sf_dir, flag)
        a = resolve.fill_target_names(a) if fmt == "metagraph" else a
        rows = a.records if odd is None else a.records.filter(F.col("query_id") % 2 == odd)
        names = [r["target_name"] for r in a.targets.orderBy("target_id").collect()] if fmt in text.HEADERS else []
        lines = materialize(rows.select(F.col("query_id").alias("place"), render(fmt, a.targets.count()).alias("value")), "rendered")
        return self.write(lines, fmt, header_lines(fmt, names))

    def targets(self) -> str:
        return self.write(sup_targets(self.spark, self.sf_dir).toDF("place", "value"), "targets")

    def fasta(self) -> str:
        rows = sup_queries(self.spark, self.sf_dir).select(
            F.col("query_id").alias("place"), F.concat(F.lit(">"), "query_name", F.lit(" of a table\nACGT\nAC")).alias("value"))
        return self.write(rows, "reads")

    def fastq(self) -> str:
        rows = sup_queries(self.spark, self.sf_dir).select(
            F.col("query_id").alias("place"), F.concat(F.lit("@"), "query_name", F.lit(" x\nACGT\n+\n@@@@")).alias("value"))
        return self.write(rows, "reads")

    def run(self, *args: str) -> None:
        cli.main(list(args), self.spark)

    def encoded(self, fmt: str, *args: str, **which) -> str:
        out = self.path("encoded")
        self.run("encode", self.lines(fmt, **which), "-o", out, "-q", self.fasta(), "-t", self.targets(), "--sample", "S", *args)
        return out

    def decoded(self, source: str, fmt: str) -> DataFrame:
        out = self.path("decoded")
        self.run("decode", source, "-o", out, "-F", fmt)
        return self.spark.read.text(out)


def _files() -> None:
    for fmt, to in (("themisto", "metagraph"), ("fulgor", "themisto"), ("metagraph", "fulgor")):
        def encode_decode(spark, sf_dir, fmt=fmt, to=to):
            files = Files(spark, sf_dir)
            return files.decoded(files.encoded(fmt), to)

        def convert(spark, sf_dir, fmt=fmt, to=to):
            files, out = Files(spark, sf_dir), shared_path(spark, "converted")
            files.run("convert", files.lines(fmt), "-o", out, "-q", files.fasta(), "-t", files.targets(), "-F", to)
            return spark.read.text(out)

        register(f"file_encode_{fmt}_decode_{to}", LINES[to])(encode_decode)
        register(f"file_convert_{fmt}_to_{to}", LINES[to])(convert)
    for op in ("intersection", "xor"):
        def command(spark, sf_dir, op=op):
            files, out = Files(spark, sf_dir), shared_path(spark, "set")
            files.run("set", op, *[files.encoded("themisto", flag=flag) for flag in "ANR"], "-o", out, "--folder")
            return files.decoded(out, "themisto")

        found = LINES["themisto"].replace(EDGES, ORACLE_SQL[f"set_{op}_3"].join("()").replace("query_id", "q").replace("target_id", "t"))
        register(f"cli_set_{op}", found)(command)


_files()


@register("file_names", "select cast(o_orderkey as bigint) as query_id, " + NAME + " as query_name from orders")
def file_names(spark, sf_dir):
    """A list of names in which every name stands twice and the order is not that of the alphabet."""
    rows = sup_queries(spark, sf_dir).select(F.col("query_id").alias("place"), F.concat("query_name", F.lit("\n"), "query_name").alias("value"))
    return text.read_names(spark, Files(spark, sf_dir).write(rows, "names"), "query")


for _kind in ("fasta", "fastq"):
    register(f"file_{_kind}", ORACLE_SQL["file_names"])(
        lambda spark, sf_dir, kind=_kind: text.read_fastx_names(spark, getattr(Files(spark, sf_dir), kind)()))


@register("file_header_targets", "select f as format, cast(s_suppkey as bigint) as target_id, s_name as target_name "
          "from supplier cross join (values ('bifrost'), ('tsv'), ('sam')) v(f)")
def file_header_targets(spark, sf_dir):
    """Target names from the headers of the formats that have them; the format is told by the first line."""
    files, found = Files(spark, sf_dir), []
    names = [r["target_name"] for r in sup_targets(spark, sf_dir).orderBy("target_id").collect()]
    lines = {"bifrost": "r", "tsv": "0\tr", "sam": "r\t4\t*"}
    for fmt, line in lines.items():
        row = spark.createDataFrame([(0, line)], "place long, value string")
        a = text.read_alignment(spark, files.write(row, fmt, header_lines(fmt, names)))
        found.append(a.targets.select(F.lit(fmt).alias("format"), "target_id", "target_name"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("file_wide_lines", f"select case when l like 'query%' then 'head' else 'line' end as kind, l as value from (select name || chr(9) || cells as l from {CELLS} c "
          f"union all select 'query_name' || chr(9) || string_agg(k, chr(9) order by t) from {TYPES} y) x")
def file_wide_lines(spark, sf_dir):
    """Wide lines written with their header and read as a file."""
    out = shared_path(spark, "wide")
    text.write_text(evt(spark, sf_dir), "bifrost", out)
    rows = spark.read.text(out)
    return rows.select(F.when(F.col("value").startswith("query_name\t"), "head").otherwise("line").alias("kind"), "value")


SAM_EDGES = EDGES.replace("from lineitem", "from lineitem where l_returnflag <> 'R'")


@register("file_sam_to_fulgor", LINES["fulgor"].replace(EDGES, SAM_EDGES).replace("from orders left join", "from (select * from orders where o_orderkey in (select l_orderkey from lineitem)) o left join"))
def file_sam_to_fulgor(spark, sf_dir):
    """SAM lines, one for each line item, unmapped where it was returned, through a container."""
    files = Files(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lost = F.col("l_returnflag") == "R"
    line = F.concat_ws("\t", F.concat(F.lit("order."), F.col("l_orderkey") + 1), F.when(lost, "77").otherwise("2064"),
                       F.when(lost, "*").otherwise(F.col("s_name")), F.lit("1"))
    names = [r["target_name"] for r in sup_targets(spark, sf_dir).orderBy("target_id").collect()]
    source = files.write(rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), line.alias("value")), "sam", header_lines("sam", names))
    out = files.path("encoded")
    files.run("encode", source, "-o", out, "-q", files.fasta())
    return files.decoded(out, "fulgor")


@register("file_cat", LINES["metagraph"])
def file_cat(spark, sf_dir):
    """Two halves, with differently compressed flags, joined by copying their blocks."""
    files, out = Files(spark, sf_dir), shared_path(spark, "cat")
    files.run("cat", files.encoded("themisto", odd=0), files.encoded("themisto", "--plain-metadata", "--folder", odd=1), "-o", out)
    return files.decoded(out, "metagraph")


@register("file_decode_order", f"""select row_number() over (order by cast(o_orderkey as bigint) // 1000, n = 0, o_orderkey) - 1 as place, cast(o_orderkey as bigint) as query_id
    from (select o_orderkey, count(t) as n from orders left join {EDGES} e on q = o_orderkey group by o_orderkey) x""")
def file_decode_order(spark, sf_dir):
    """Places of the lines of a decoded container: by block, queries with hits first."""
    files, out = Files(spark, sf_dir), shared_path(spark, "decoded")
    files.run("decode", files.encoded("themisto", "--block-size", "1000"), "-o", out, "-F", "themisto")
    rows = text.with_row_index(text.lines(spark, out))
    return rows.select(F.col("row_idx").alias("place"), F.substring_index("value", " ", 1).cast("long").alias("query_id"))


@register("encode_input_order", """select p // 1000 as block_id, count(*) as num_records, min(q) as first_id, max(q) as last_id from (
    select cast(o_orderkey as bigint) q, row_number() over (order by o_orderkey % 7, o_orderkey) - 1 as p from orders) x group by 1""")
def encode_input_order(spark, sf_dir):
    """Blocks follow the input, whose ids are dealt out by their remainder."""
    files, out = Files(spark, sf_dir), shared_path(spark, "encoded")
    a = sup(spark, sf_dir)
    place = (F.col("query_id") % 7) * (1 << 40) + F.col("query_id")
    source = files.write(materialize(a.records.select(place.alias("place"), render("themisto").alias("value")), "rendered"), "lines")
    files.run("encode", source, "-o", out, "-t", files.targets(), "--sample", "S", "--block-size", "1000")
    return container.read_view(spark, out, "index").select("block_id", "num_records", "first_id", "last_id")


@register("file_rename", """select cast(o_orderkey as bigint) as query_id,
    'S' || cast(row_number() over (order by o_orderkey % 7, o_orderkey) as varchar) as query_name from orders""")
def file_rename(spark, sf_dir):
    """Names by the place of the line in the input, read back from the flags."""
    files, out = Files(spark, sf_dir), shared_path(spark, "encoded")
    a = sup(spark, sf_dir)
    place = (F.col("query_id") % 7) * (1 << 40) + F.col("query_id")
    source = files.write(materialize(a.records.select(place.alias("place"), render("themisto").alias("value")), "rendered"), "lines")
    files.run("encode", source, "-o", out, "-t", files.targets(), "--sample", "S", "--rename")
    return container.read_queries(spark, out)


@register("container_strip_names", "select cast(o_orderkey as bigint) as query_id, 'S.' || cast(o_orderkey + 1 as varchar) as query_name from orders")
def container_strip_names(spark, sf_dir):
    files = Files(spark, sf_dir)
    return container.read_queries(spark, files.encoded("themisto", "--strip-names"))


@register("container_info", """select (select count(*) from supplier) as n_targets, (select count(*) from orders) as n_queries,
    cast(700 as bigint) as block_size, cast(3 as bigint) as fields_present, 'S' as sample, s_name as last_target from supplier order by s_suppkey desc limit 1""")
def container_info(spark, sf_dir):
    files = Files(spark, sf_dir)
    got = container.info(files.encoded("themisto", "--block-size", "700"))
    row = (got["n_targets"], got["n_queries"], got["block_size"], got["fields_present"], got["sample"], got["targets"][-1])
    return spark.createDataFrame([row], "n_targets long, n_queries long, block_size long, fields_present long, sample string, last_target string")


@register("errors", """select * from (values ('unknown query name', 'KeyNotFound'), ('unknown query id', 'IndexNotFound'), ('unknown target name', 'KeyNotFound'),
    ('target id too large', 'IndexNotFound'), ('no query list', 'NeedQueryNamesErr'), ('no target list', 'NeedTargetSequences'),
    ('same query twice', 'DuplicatedQueriesErr'), ('other targets', 'IncompatibleFileHeadersErr'), ('other fields', 'IncompatibleFileHeadersErr'),
    ('ambiguous line', 'AmbiguousInputFormatErr'), ('unknown line', 'UnrecognizedInputFormatErr'), ('number too large', 'CorruptedInputErr'),
    ('bits out of order', 'SetBitsNotSorted'), ('no hits said', 'FieldMissing'), ('wide id', 'InvalidConversion')) v(case_name, error)""")
def errors(spark, sf_dir):
    """What each kind of bad input stops with."""
    files = Files(spark, sf_dir)
    targets, queries = sup_targets(spark, sf_dir), sup_queries(spark, sf_dir)
    whole = files.encoded("themisto")
    bare = files.encoded("themisto", "--strip-names")
    few = files.path("few")
    container.write_container(Alignment(sup(spark, sf_dir).records, targets.filter("target_id > 0"), None, "S").with_records(
        spark.createDataFrame([(1 << 31, "x", [])], "query_id long, query_name string, ones array<long>")), few)

    def records(query_id=None, query_name=None, ones=None, ones_names=None):
        row = (query_id, query_name, ones, ones_names)
        return Alignment(spark.createDataFrame([row], "query_id long, query_name string, ones array<long>, ones_names array<string>"), targets, queries)

    def lines(line, **options):
        path = files.write(spark.createDataFrame([(0, line)], "place long, value string"), "bad")
        return text.read_alignment(spark, path, **options).records.collect()

    huge = 1 << 40
    cases = {
        "unknown query name": lambda: resolve.fill_query_ids(records(query_name="nobody")).records.collect(),
        "unknown query id": lambda: resolve.fill_query_names(records(query_id=huge)).records.collect(),
        "unknown target name": lambda: resolve.fill_target_ids(records(ones_names=["nothing"])).records.collect(),
        "target id too large": lambda: resolve.fill_target_names(records(ones=[huge])).records.collect(),
        "no query list": lambda: resolve.fill_query_ids(Alignment(records(query_name="a").records, targets)),
        "no target list": lambda: lines("8 1"),
        "same query twice": lambda: api.cat(spark, [whole, whole], files.path("cat")),
        "other targets": lambda: api.cat(spark, [whole, few], files.path("cat")),
        "other fields": lambda: container.append(spark, [whole, bare], files.path("cat")),
        "ambiguous line": lambda: lines("11301\t0"),
        "unknown line": lambda: lines("a\tb"),
        "number too large": lambda: lines("4294967296 1", targets=targets),
        "bits out of order": lambda: container.encode_bitmap([3, 1]),
        "no hits said": lambda: api.prepare(records(query_id=0), "error").records.collect(),
        "wide id": lambda: container.encode_block([0], [huge]),
    }
    found = []
    for name, run in cases.items():
        try:
            run()
            found.append((name, "none"))
        except AlignmentError as e:
            found.append((name, type(e).__name__))
        except Exception as e:  # what executors raise carries the name in its text
            known = [x for x in ("KeyNotFound", "IndexNotFound", "CorruptedInputErr", "FieldMissing") if f"{x}:" in str(e)]
            found.append((name, known[0] if known else type(e).__name__))
    return spark.createDataFrame(found, "case_name string, error string")


def _streamed(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    query = rows.writeStream.format(kind).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return getattr(spark.read, kind)(out)


@register("stream_convert", LINES["fulgor"].replace("select " + NAME, "select cast(o_orderkey as varchar)"))
def stream_convert(spark, sf_dir):
    """One format to another on a stream of files; the id stands for the name."""
    source = Files(spark, sf_dir).lines("themisto")
    records = read_stream(spark, source, "themisto").withColumn("query_name", F.col("query_id").cast("string"))
    return _streamed(spark, render_stream(records, "fulgor"), "text")


@register("stream_unique_edges", f"select q as query_id, t as target_id from {EDGES} e")
def stream_unique_edges(spark, sf_dir):
    """Distinct pairs of a stream in which every line comes twice."""
    rows = _rendered(spark, sf_dir, "themisto")
    source = shared_path(spark, "stream-in")
    rows.unionAll(rows).write.text(source)
    return _streamed(spark, unique_edges(read_stream(spark, source, "themisto")), "parquet")


@register("sniff_lines", """select f as format, count(*) as n from (select 'themisto' as f from orders union all select 'fulgor' from orders
    union all select 'metagraph' from orders) x group by f""")
def sniff_lines(spark, sf_dir):
    """The format of every rendered line: ids and names tell them apart."""
    lines = [_rendered(spark, sf_dir, fmt).select(F.concat("value", F.lit("\t" if fmt == "fulgor" else "")).alias("value")) for fmt in ("themisto", "fulgor", "metagraph")]
    every = lines[0].unionAll(lines[1]).unionAll(lines[2])
    return every.groupBy(sniff_column(F.col("value")).alias("format")).agg(F.count("*").alias("n"))
