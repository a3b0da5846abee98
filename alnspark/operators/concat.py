"""Concatenation: union of matrices that share no query."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicatedQueriesErr, IncompatibleFileHeadersErr, QueryIdsNotFilled
from ..model import Alignment


def duplicates(records: DataFrame) -> DataFrame:
    """Ids that occur more than once, and how often."""
    return records.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1")


def same_targets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two target dictionaries are equal."""
    other = b.select(F.col("target_id").alias("__i"), F.col("target_name").alias("__n"))
    both = a.join(other, F.col("target_id") == F.col("__i"), "full")
    return both.filter(~F.col("target_name").eqNullSafe(F.col("__n"))).isEmpty()


def concatenate(inputs: list[Alignment]) -> Alignment:
    """Records of all inputs; sample and targets of the first.  Inputs must have equal targets and
    fields, and no query may occur twice."""
    first = inputs[0]
    for other in inputs[1:]:
        if (first.targets is None) != (other.targets is None) or (
            first.targets is not None and not same_targets(first.targets, other.targets)
        ):
            raise IncompatibleFileHeadersErr("inputs have different targets")
        if set(first.records.columns) != set(other.records.columns):
            raise IncompatibleFileHeadersErr("inputs hold different fields")
    records = reduce(DataFrame.unionByName, [a.records for a in inputs])
    if not records.filter(F.col("query_id").isNull()).isEmpty():
        raise QueryIdsNotFilled("a record has no query id")
    if not duplicates(records).isEmpty():
        raise DuplicatedQueriesErr("a query occurs more than once")
    lists = [a.queries for a in inputs]
    queries = None if any(q is None for q in lists) else reduce(DataFrame.unionByName, lists).distinct()
    return replace(first, records=records, queries=queries)
