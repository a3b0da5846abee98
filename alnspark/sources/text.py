"""Reading and writing the text formats, and the lists of names."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptedInputErr, NeedTargetSequences
from ..functions.sniff import sniff
from ..functions.text_formats import HEADERS, fail, header_lines, parse, render
from ..model import Alignment, dictionary
from ..operators.concat import same_targets
from ..workspace import materialize


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (value, file, block, place): splits of a file may run in any order, so
    its name, the split's offset and the place within the split give the order."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def with_row_index(rows: DataFrame) -> DataFrame:
    """Append ``row_idx``, the number of a line from 0.

    Only one count for each split reaches the driver; lines are numbered where they are read.
    """
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    starts, total = [], 0
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        starts.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "file string, block long, shift long")
    return rows.join(F.broadcast(table), ["file", "block"]).select("value", (F.col("place") + F.col("shift")).alias("row_idx"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of the first file that has one: a few files are looked at one by one, of each
    the first split, before all lines are put in order."""
    for file in [*sorted(spark.read.text(path).inputFiles())[:3], None]:
        rows = lines(spark, path)
        if file is not None:  # a local file has one slash or three
            rows = rows.filter(F.col("file").isin(file, file.replace("file:///", "file:/")) & (F.col("block") == 0))
        got = rows.orderBy("file", "block", "place").limit(1).collect()
        if got:
            return got[0]["value"]
    return ""


def read_names(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A dictionary from a list with one name a line (``kind``: target or query)."""
    rows = with_row_index(lines(spark, path))
    return dictionary(rows.withColumnRenamed("value", "name"), "row_idx", "name", kind)


def read_fastx_names(spark: SparkSession, path: str) -> DataFrame:
    """The query dictionary of a FASTA or FASTQ file (gzip is read too): what follows the mark, up to
    the first space.

    FASTQ records have four lines each; blank lines after the last record are skipped, and any other
    line in the place of a head that lacks its mark is an error.
    """
    rows = with_row_index(lines(spark, path)).withColumn("value", F.rtrim("value", F.lit("\r")))
    mark = first_line(spark, path)[:1]
    if mark == ">":
        heads = rows.filter(F.col("value").startswith(">"))
    elif mark == "@":
        last = rows.filter("value <> ''").agg(F.max("row_idx").alias("n")).first()["n"]
        heads = rows.filter((F.col("row_idx") % 4 == 0) & (F.col("row_idx") <= last))
        marked = F.when(F.col("value").startswith("@"), F.col("value"))
        heads = heads.withColumn("value", F.coalesce(marked, fail("CorruptedInputErr", "a FASTQ head without its mark").cast("string")))
    else:
        raise CorruptedInputErr("neither FASTA nor FASTQ")
    names = heads.select("row_idx", F.substring_index(F.expr("substring(value, 2)"), " ", 1).alias("name"))
    return dictionary(names, "row_idx", "name", "query")


def target_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """A target dictionary from names in order; repeated names count once."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "target_id long, target_name string")


def read_alignment(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    targets: DataFrame | None = None,
    queries: DataFrame | None = None,
    sample: str = "",
    trim_trailing: bool = False,
) -> Alignment:
    """Parse a text file; the format is told by its first line unless given.

    Given targets override those of a header (with a warning if they differ) without reordering
    columns.  Formats whose lines name no targets need a target list.
    """
    head = first_line(spark, path)
    fmt = format or sniff(head)
    rows = with_row_index(lines(spark, path))
    own = None
    if fmt in HEADERS:
        own = target_table(spark, head.split("\t")[len(HEADERS[fmt]):])
        rows = rows.filter("row_idx > 0")
    elif fmt == "sam":
        sq = rows.filter(F.col("value").startswith("@SQ")).select("row_idx", F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("name"))
        own = dictionary(sq, "row_idx", "name", "target")
        rows = rows.filter(~F.col("value").startswith("@"))
    if targets is None:
        targets = own
    elif own is not None and not same_targets(targets, own):
        warnings.warn("the given targets differ from the header's", stacklevel=2)
    if targets is None:
        raise NeedTargetSequences(f"{fmt} lines do not name the targets")
    value = F.rtrim("value") if trim_trailing else F.col("value")
    records = parse(rows, fmt, value, ["row_idx"])
    return Alignment(records, targets, queries, sample)


def rendered(a: Alignment, fmt: str, order: list[str] | None = None) -> DataFrame:
    """Lines of the records, without a header: ``value`` and the columns that give their ``order``."""
    n = a.targets.count() if fmt in HEADERS else 0
    if order is None:
        order = ["row_idx" if "row_idx" in a.records.columns else "query_id"]
    return a.records.select(*order, render(fmt, n).alias("value"))


def write_text(a: Alignment, fmt: str, path: str, order: list[str] | None = None) -> None:
    """Write lines as a folder of parts, in input order or by the columns ``order``: the header, if
    the format has one and there are records, is the first line of the first part.  Lines are
    computed once."""
    out = materialize(rendered(a, fmt, order), "lines")
    by = [c for c in out.columns if c != "value"]
    if fmt in HEADERS and not out.isEmpty():
        names = [r["target_name"] for r in a.targets.orderBy("target_id").select("target_name").toLocalIterator()]
        head = out.sparkSession.createDataFrame([(x,) for x in header_lines(fmt, names)], "value string")
        out = head.select(*[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in by], "value").unionByName(out)
    # nulls, and so the header, come first
    out.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def stream_lines(spark: SparkSession, path: str):
    """Lines of a text file or of a folder of parts, in order, one after another (for a pipe)."""
    for r in lines(spark, path).orderBy("file", "block", "place").select("value").toLocalIterator():
        yield r["value"]
