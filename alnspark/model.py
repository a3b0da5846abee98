"""The data model: records of a sparse boolean matrix of queries and targets, and its dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import materialize

LONGS = T.ArrayType(T.LongType(), False)
STRINGS = T.ArrayType(T.StringType(), False)

#: A null ``ones`` means that the format did not say; an empty one, aligned to nothing.
RECORD = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("ones", LONGS),
    T.StructField("ones_names", STRINGS),
])
U32_MAX = 4294967295


@dataclass(frozen=True)
class Alignment:
    """Records with what is needed to read them.

    ``records``: the columns of ``RECORD`` and, where the order of the input matters, ``row_idx``.
    ``targets``: (target_id, target_name).  ``queries``: (query_id, query_name), the query universe.
    """

    records: DataFrame
    targets: DataFrame | None = None
    queries: DataFrame | None = None
    sample: str = ""

    def with_records(self, records: DataFrame) -> Alignment:
        return replace(self, records=records)


def dictionary(names: DataFrame, position: str, name: str, kind: str) -> DataFrame:
    """Ids of distinct names: the rank of their first occurrence."""
    first = names.groupBy(F.col(name).alias(f"{kind}_name")).agg(F.min(position).alias("first"))
    return dense_rank_by(first, "first", f"{kind}_id").select(f"{kind}_id", f"{kind}_name")


def dense_places(rows: DataFrame, key: str) -> Column | None:
    """Places of rows by a unique key, if its values follow each other without a gap; else nothing."""
    r = rows.agg(F.count("*").alias("n"), F.count(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most")).first()
    if r["n"] != r["keys"] or (r["n"] and r["most"] - r["least"] + 1 != r["n"]):
        return None
    return F.col(key) - F.lit(r["least"] or 0)


def dense_rank_by(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Number rows from 0 by a unique key, without any task seeing all of them.

    The rows are sorted by ranges and written once, each with the range it fell into and its place
    there.  Only what was written is counted and numbered: range bounds come from a sample, so a
    second evaluation might cut elsewhere.  One number for each range reaches the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    written = materialize(ordered.withColumn("__p", F.spark_partition_id()).withColumn("__m", place), "ranked")
    starts, total = [], 0
    for r in sorted(written.groupBy("__p").count().collect()):
        starts.append((r["__p"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "__p int, __start long")
    return written.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__start") + F.col("__m")).drop("__p", "__start", "__m")
