"""Filling ids and names from dictionaries: strict lookups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NeedQueryNamesErr
from ..functions.text_formats import fail
from ..model import Alignment
from ..workspace import materialize

#: Dictionaries of at most so many bytes are sent to every task; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _facts(table: DataFrame):
    """Of a dictionary: bytes, rows, and the least and greatest value of a numeric first column."""
    sizes = [F.octet_length(c) if t == "string" else F.lit(8) for c, t in table.dtypes]
    first = F.col(table.columns[0])
    return table.agg(
        F.coalesce(F.sum(sum(sizes[1:], sizes[0]) + 32), F.lit(0)).alias("bytes"), F.count("*").alias("n"),
        F.count_distinct(first).alias("distinct"), F.min(first).alias("least"), F.max(first).alias("most"),
    ).first()


def small(table: DataFrame) -> bool:
    """Whether a dictionary's measured size (names and ids) allows a broadcast."""
    sizes = [F.octet_length(c) if t == "string" else F.lit(8) for c, t in table.dtypes]
    total = table.agg(F.sum(sum(sizes[1:], sizes[0]) + 32).alias("n")).first()["n"] or 0
    return total <= BROADCAST_BYTES


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if small(table) else table


def _lookup(rows: DataFrame, table: DataFrame, key: str, value: str, error: str) -> DataFrame:
    """Fill a null ``value`` from ``table`` by ``key``; a key without a row is an error."""
    own = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    # rows without a key match nothing; dealt by the other column, they do not all go to one task
    dealt = F.coalesce(key, F.xxhash64(value).cast(rows.schema[key].dataType))
    joined = rows.join(_sized(own), (dealt == F.col("__k")) & F.col(key).isNotNull(), "left")
    missed = F.col(value).isNull() & F.col(key).isNotNull() & F.col("__k").isNull()
    got = F.when(missed, fail(error, F.col(key).cast("string")).cast(rows.schema[value].dataType)).otherwise(F.coalesce(value, "__v"))
    return joined.withColumn(value, got).drop("__k", "__v")


def fill_query_ids(a: Alignment) -> Alignment:
    """Ids from names."""
    if a.queries is None:
        raise NeedQueryNamesErr("ids of named queries need the query list")
    return a.with_records(_lookup(a.records, a.queries, "query_name", "query_id", "KeyNotFound"))


def fill_query_names(a: Alignment, fallback: bool = False) -> Alignment:
    """Names from ids; with ``fallback``, missing ones become the sample, a dot and the id plus one."""
    records = a.records
    if a.queries is not None:
        records = _lookup(records, a.queries, "query_id", "query_name", "IndexNotFound") if not fallback else (
            records.join(_sized(a.queries.select(F.col("query_id").alias("__k"), F.col("query_name").alias("__v"))),
                         F.col("query_id") == F.col("__k"), "left")
            .withColumn("query_name", F.coalesce("query_name", "__v")).drop("__k", "__v"))
    elif not fallback:
        raise NeedQueryNamesErr("names of queries need the query list")
    if fallback:
        records = records.withColumn("query_name", F.coalesce("query_name", F.concat(F.lit(a.sample + "."), F.col("query_id") + 1)))
    return a.with_records(records)


def _map_targets(a: Alignment, have: str, want: str, key: str, value: str, error: str) -> Alignment:
    """Turn arrays of target ids into names or back, in order.

    If the ids of a dictionary of checked size are 0, 1, 2 and so on, they are places in one array
    of names.  Otherwise entries are exploded, joined with the dictionary and gathered again by the
    number of their record, which keeps nulls, empty arrays, repeated entries and order; numbered
    records are written first, so that a lost executor cannot number them anew.  If nothing is left
    to fill, they stay as they are.
    """
    table = a.targets.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    kind = a.targets.schema[value].dataType
    missing = fail(error, F.col("__k").cast("string")).cast(kind)
    if key == "target_id":
        facts = _facts(a.targets.select("target_id", "target_name"))
        dense = facts["n"] == 0 or (facts["distinct"] == facts["n"] and facts["least"] == 0 and facts["most"] == facts["n"] - 1)
        if dense and facts["bytes"] <= BROADCAST_BYTES:
            names = a.targets.agg(F.array_sort(F.collect_list(F.struct("target_id", "target_name"))).alias("l")).select("l.target_name")
            out = a.records.withColumn("__names", names.scalar())

            def entry(x):
                inside = (x >= 0) & (x < F.lit(facts["n"]))
                return F.when(inside, F.get("__names", x.cast("int"))).otherwise(fail(error, x.cast("string")).cast(kind))

            return a.with_records(out.withColumn(want, F.coalesce(F.col(want), F.transform(F.col(have), entry))).drop("__names"))
    kept = a.records.columns
    rows = materialize(a.records.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    if rows.filter(F.col(want).isNull() & F.col(have).isNotNull()).isEmpty():
        return a.with_records(rows.select(kept))
    todo = F.when(F.col(want).isNull(), F.col(have))
    entries = rows.select("__row", F.posexplode(todo).alias("__pos", "__k")).join(_sized(table), "__k", "left")
    entries = entries.select("__row", F.struct("__pos", F.coalesce("__v", missing).alias("__v")).alias("__e"))
    lists = entries.groupBy("__row").agg(F.array_sort(F.collect_list("__e")).alias("__l"))
    filled = F.when(F.col(have).isNotNull(), F.coalesce(F.col("__l.__v"), F.array().cast(rows.schema[want].dataType)))
    return a.with_records(rows.join(lists, "__row", "left").withColumn(want, F.coalesce(F.col(want), filled)).select(kept))


def fill_target_names(a: Alignment) -> Alignment:
    """``ones_names`` from ``ones``."""
    return _map_targets(a, "ones", "ones_names", "target_id", "target_name", "IndexNotFound")


def fill_target_ids(a: Alignment) -> Alignment:
    """``ones`` from ``ones_names``."""
    return _map_targets(a, "ones_names", "ones", "target_name", "target_id", "KeyNotFound")


def fill(a: Alignment, columns: list[str], fallback: bool = False) -> Alignment:
    """Fill the asked columns, as far as anything is null there, and null the rest."""
    if "query_id" in columns:
        a = fill_query_ids(a) if a.queries is not None else a
    if "query_name" in columns:
        a = fill_query_names(a, fallback) if a.queries is not None or fallback else a
    if a.targets is not None and "ones" in columns:
        a = fill_target_ids(a)
    if a.targets is not None and "ones_names" in columns:
        a = fill_target_names(a)
    kinds = dict(a.records.dtypes)
    for c in ("query_id", "query_name", "ones", "ones_names"):
        if c not in columns:
            a = a.with_records(a.records.withColumn(c, F.lit(None).cast(kinds[c])))
    return a


def rename_queries(records: DataFrame, accession: str) -> DataFrame:
    """Names by place in the input: the accession and the place plus one, without a mark between."""
    return records.withColumn("query_name", F.concat(F.lit(accession), F.col("row_idx") + 1))


def strip_names(records: DataFrame, queries: bool = True, targets: bool = True) -> DataFrame:
    for c, drop in (("query_name", queries), ("ones_names", targets)):
        if drop:
            records = records.withColumn(c, F.lit(None).cast(records.schema[c].dataType))
    return records
