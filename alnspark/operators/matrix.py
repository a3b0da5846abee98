"""The matrix behind the records: bits, regrouping, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text_formats import fail


def edges(records: DataFrame) -> DataFrame:
    """Distinct (query_id, target_id); records that say nothing or hold nothing have none."""
    return records.select("query_id", F.explode("ones").alias("target_id")).distinct()


def bits(pairs: DataFrame, n_targets: int) -> DataFrame:
    """Row-major bit numbers of pairs; a target outside the dictionary is an error."""
    inside = (F.col("target_id") >= 0) & (F.col("target_id") < n_targets)
    bit = F.col("query_id") * F.lit(n_targets).cast("long") + F.col("target_id")
    return pairs.select(F.when(inside, bit).otherwise(fail("IndexNotFound", F.col("target_id").cast("string")).cast("long")).alias("bit"))


def from_bits(bit_rows: DataFrame, n_targets: int) -> DataFrame:
    """Pairs of bit numbers."""
    n = F.lit(n_targets).cast("long")
    return bit_rows.select(F.expr(f"bit div {int(n_targets)}L").alias("query_id"), (F.col("bit") % n).alias("target_id"))


def regroup(pairs: DataFrame) -> DataFrame:
    """One record for each query with a hit, targets ascending and distinct."""
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("target_id")).alias("ones"))


def pad(records: DataFrame, queries: DataFrame) -> DataFrame:
    """All queries of the universe: those without a record are aligned to nothing."""
    own = records.select(F.col("query_id").alias("__q"), "ones")
    joined = queries.join(own, F.col("query_id") == F.col("__q"), "left").drop("__q")
    return joined.withColumn("ones", F.coalesce("ones", F.array().cast("array<bigint>")))


def repeated(records: DataFrame) -> bool:
    """Whether a query has more than one record."""
    r = records.agg(F.count("*").alias("n"), F.count("query_id").alias("said"), F.count_distinct("query_id").alias("ids")).first()
    return r["ids"] < r["said"] or r["n"] - r["said"] > 1


def collapse(records: DataFrame, place: str | None = None) -> DataFrame:
    """Several records of a query as one; null only if none of them says anything.  ``place``: a
    column of which the least value is kept."""
    said = F.col("ones").isNotNull()
    first = [F.min(place).alias(place)] if place else []
    return records.groupBy("query_id").agg(
        F.max("query_name").alias("query_name"),
        F.when(F.max(said.cast("int")) == 1, F.array_sort(F.array_distinct(F.flatten(F.collect_list("ones"))))).alias("ones"),
        *first,
    )
