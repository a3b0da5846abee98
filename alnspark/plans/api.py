"""The five verbs: encode, decode, convert, concatenate, set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicatedQueriesErr, NeedQueryNamesErr
from ..functions.text_formats import SHOWN
from ..model import Alignment
from ..operators import concat, matrix, resolve, set_ops
from ..sources import container, layout
from ..sources.text import read_alignment, target_table, write_text
from ..workspace import materialize

#: Formats whose lines name queries but do not number them.
UNNUMBERED = ("fulgor", "bifrost", "sam")


def prepare(a: Alignment, unmapped: str = "empty") -> Alignment:
    """One record a query with ids and ones filled, as a container needs it."""
    a = a.with_records(materialize(a.records, "parsed"))
    lacks = _lacking(a.records)
    if a.queries is not None:
        # a join is made only if it has something to fill
        a = resolve.fill_query_ids(a) if lacks["ids"] else a
        a = resolve.fill_query_names(a) if lacks["names"] else a
    elif lacks["any_id"]:
        raise NeedQueryNamesErr("named queries need the query list")
    a = resolve.fill_target_ids(a) if lacks["ones"] else a
    if unmapped == "error":
        said = F.when(F.col("ones").isNull(), F.raise_error("FieldMissing: ones").cast("array<bigint>")).otherwise(F.col("ones"))
        a = a.with_records(a.records.withColumn("ones", said))
    place = "row_idx" if "row_idx" in a.records.columns else None
    own = a.records.withColumn("ones", F.array_sort(F.array_distinct("ones"))).drop("ones_names")
    merged = materialize(own, "prepared")
    if matrix.repeated(merged):
        # many rows of a query (as SAM has) become one; the first place in the input counts
        merged = materialize(matrix.collapse(merged, place), "collapsed")
    return a.with_records(merged.withColumn("ones_names", F.lit(None).cast("array<string>")))


def _lacking(records: DataFrame) -> Row:
    """How many records lack an id that their name gives, a name that their id gives, ones that names
    give, and an id at all; those of a column may lack the other too, until it is filled."""
    no_id, no_name = F.col("query_id").isNull(), F.col("query_name").isNull()
    return records.agg(
        F.count_if(no_id & ~no_name).alias("ids"), F.count_if(no_name & ~no_id).alias("names"),
        F.count_if(F.col("ones").isNull() & F.col("ones_names").isNotNull()).alias("ones"), F.count_if(no_id).alias("any_id"),
    ).first()


def encode(
    spark: SparkSession, source: str, path: str, targets: DataFrame | None = None, queries: DataFrame | None = None, sample: str = "",
    format: str | None = None, rename: bool = False, strip_names: bool = False, block_size: int | None = None,
    compression: int = layout.GZIP, unmapped: str = "empty", trim_trailing: bool = False, by: str = "row_idx", folder: bool = False,
) -> None:
    """Text to container, with blocks in input order (``by="query_id"``: by ranges of ids)."""
    a = prepare(read_alignment(spark, source, format, targets, queries, sample, trim_trailing), unmapped)
    if rename:
        a = a.with_records(resolve.rename_queries(a.records, sample))
    named = not strip_names and (rename or a.records.filter("query_name IS NULL").isEmpty())
    container.write_container(a, path, block_size=block_size, compression=compression, names=named, by=by, folder=folder, written=True)


def decode(spark: SparkSession, source: str, path: str, format: str = "tsv") -> None:
    """Container to text, in the order of its blocks."""
    if format not in SHOWN:
        raise NotImplementedError("SAM records can be read, not written")
    a = container.read_container(spark, source)
    # the order is kept apart, as fields that the format does not show are emptied
    place = F.struct(*container.DECODE_ORDER).alias("place")
    ordered = container.decode_order(a.records).select("*", place).drop("block_id", "no_hits")
    # a container holds the ids of all targets, so only their names may have to be filled
    targets = a.targets if "ones_names" in SHOWN[format] else None
    filled = resolve.fill(Alignment(ordered, targets, None, a.sample), SHOWN[format], fallback=True)
    write_text(Alignment(filled.records, a.targets, None, a.sample), format, path, ["place"])


def convert(
    spark: SparkSession, source: str, path: str, to: str, targets: DataFrame | None = None, queries: DataFrame | None = None,
    format: str | None = None, trim_trailing: bool = False,
) -> None:
    """Text to text, keeping the order of lines and of the entries in them."""
    write_text(converted(read_alignment(spark, source, format, targets, queries, "", trim_trailing), to), to, path)


def converted(a: Alignment, to: str) -> Alignment:
    """Records with what the format shows filled in."""
    if to not in SHOWN:
        raise NotImplementedError("SAM records can be read, not written")
    return resolve.fill(a, SHOWN[to])


def cat(spark: SparkSession, sources: list[str], path: str, compression: int = layout.GZIP, folder: bool = False) -> None:
    """Containers with the same targets and no common query, as one: blocks are copied as they are."""
    ids = [container.read_view(spark, s, "queries") for s in sources]
    if not concat.duplicates(reduce(DataFrame.unionByName, ids)).isEmpty():
        raise DuplicatedQueriesErr("a query occurs more than once")
    container.append(spark, sources, path, compression, folder)


def merge(
    spark: SparkSession, sources: list[str], path: str, operation: str, sample: str = "", universe: str = "first", folder: bool = False
) -> None:
    """A set operation over containers; header, targets, names and universe come from the first."""
    head, own, targets, _ = container.read_head(sources[0])
    inputs = [container.read_view(spark, s, "edges") for s in sources]
    records = set_ops.combine_records(inputs, operation, container.read_queries(spark, sources[0]), universe)
    if universe == "all":
        records = records.withColumn("query_name", F.coalesce("query_name", F.concat(F.lit(own + "."), F.col("query_id") + 1)))
    out = Alignment(records, target_table(spark, targets), None, sample or own)
    container.write_container(out, path, names=bool(head.fields_present & layout.HAS_NAMES), folder=folder)
