"""Streams of text lines through the same parsers and renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_formats import HEADERS, parse, render


def read_stream(spark: SparkSession, folder: str, format: str, trim_trailing: bool = False) -> DataFrame:
    """Records of text files as they appear in a folder; header lines are left out.  The format must
    be given, as a stream has no first line, and lines have no number."""
    rows = spark.readStream.text(folder)
    value = F.rtrim("value") if trim_trailing else F.col("value")
    if format in HEADERS:
        rows = rows.filter(~F.col("value").startswith(HEADERS[format][0] + "\t"))
    elif format == "sam":
        rows = rows.filter(~F.col("value").startswith("@"))
    return parse(rows, format, value)


def render_stream(records: DataFrame, format: str, n_targets: int = 0) -> DataFrame:
    """Lines of a stream of records, for ``writeStream.format("text")``."""
    return records.select(render(format, n_targets).alias("value"))


def unique_edges(records: DataFrame) -> DataFrame:
    """Distinct (query_id, target_id) of a stream; its state grows with the number of pairs."""
    return records.select("query_id", F.explode("ones").alias("target_id")).dropDuplicates(["query_id", "target_id"])
