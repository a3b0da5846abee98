"""Set operations over any number of matrices: one shuffle, whatever their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import pad, regroup

OPERATIONS = ("union", "intersection", "xor", "diff")


def _tagged(inputs: list[DataFrame]) -> DataFrame:
    wide = len(inputs) > 62
    tagged = [x.select("query_id", "target_id", F.lit(i if wide else 1 << i).cast("long").alias("i")) for i, x in enumerate(inputs)]
    return reduce(DataFrame.unionByName, tagged)


def combine(inputs: list[DataFrame], operation: str) -> DataFrame:
    """Pairs (query_id, target_id) in any input, in all, in an odd number, or in the first only.

    Pairs may be repeated within an input.  The inputs that hold a pair are kept as bits of an
    aggregate of fixed width (a list of numbers beyond 62 inputs), so partial aggregation works
    before the shuffle.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    if not inputs:
        raise ValueError("at least one input is needed")
    k = len(inputs)
    rows = _tagged(inputs)
    if operation == "union":
        return rows.select("query_id", "target_id").distinct()
    if k <= 62:
        grouped = rows.groupBy("query_id", "target_id").agg(F.bit_or("i").alias("m"))
        n, first_only = F.bit_count("m"), F.col("m") == 1
    else:
        grouped = rows.distinct().groupBy("query_id", "target_id").agg(F.count("*").alias("n"), F.min("i").alias("least"))
        n, first_only = F.col("n"), (F.col("least") == 0) & (F.col("n") == 1)
    keep = {"intersection": n == k, "xor": n % 2 == 1, "diff": first_only}[operation]
    return grouped.filter(keep).select("query_id", "target_id")


def combine_records(inputs: list[DataFrame], operation: str, queries: DataFrame, universe: str = "first") -> DataFrame:
    """Records of the result.  ``queries``: the universe of the first input, all of which is kept;
    pairs outside it are dropped (``first``) or added to it (``all``)."""
    found = regroup(combine(inputs, operation))
    if universe == "first":
        return pad(found, queries)
    if universe != "all":
        raise ValueError("universe is 'first' or 'all'")
    own = found.select(F.col("query_id").alias("__q"), "ones")
    joined = queries.join(own, F.col("query_id") == F.col("__q"), "full")
    rest = [c for c in queries.columns if c != "query_id"]
    return joined.select(F.coalesce("query_id", "__q").alias("query_id"), *rest,
                         F.coalesce("ones", F.array().cast("array<bigint>")).alias("ones"))
