"""Operator 9: sharding by longest-processing-time scheduling.

Rows of a group (equal texts) stay together.  Units, sorted by size, go to the least-loaded shard
through a heap.  A unit is a group of its own if it holds more than 1/``UNITS`` of all bytes (there
are fewer than ``UNITS`` such groups); smaller groups are first gathered by a hash into ``UNITS``
units.  So the driver sees at most twice ``UNITS`` sizes however many groups there are, and no shard
differs from another by more than about the size of a unit or of the largest group.

Slots number the rows of a shard without gaps: rows are spread evenly over chunks, chunk sizes
(at most ``CHUNKS`` a shard) give each chunk its first slot, and rows are numbered inside chunks.

DataFrame functions only.

Edge cases: a null text has no bytes (size 1) and goes with the empty texts; a very long text is one
size among others; of equally large units the first in the order of their names goes first, of
equally loaded shards the first gets it; repeated rows stay together and get slots of their own; an
empty table gives an empty result; shards may stay empty if there are fewer groups than shards; only
the id and text columns are read, so others cannot clash with the output.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

UNITS, CHUNKS = 16_384, 1024
#: Rows of a chunk that are aimed at.
CHUNK_ROWS = 2_000


def longest_first(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each unit: units by falling size, each to the least-loaded shard (ties: first)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``size``, ``text_crc32``, ``law`` (``bytes``), ``shard``,
    ``slot`` and ``grown_shard`` (null: this law has no growth rule)."""
    spark = docs.sparkSession
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(
        column(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    whole = groups.agg(F.sum("size").alias("n")).first()["n"] or 0
    heavy = F.col("size") > F.lit(whole // UNITS)
    unit = F.pmod("key", F.lit(UNITS))
    large = {("group", r["key"]): r["size"] for r in groups.filter(heavy).collect()}
    small = groups.filter(~heavy).groupBy(unit.alias("unit")).agg(F.sum("size").alias("size"))
    sizes = large | {("unit", r["unit"]): r["size"] for r in small.collect()}
    where = longest_first(list(sizes.items()), shards)
    own = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == "group"], "key long, own int")
    shared = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == "unit"], "unit long, shared int")
    placed = rows.join(F.broadcast(own), "key", "left").withColumn("unit", unit)
    placed = placed.join(F.broadcast(shared), "unit", "left")
    chunks = max(1, min(CHUNKS, rows.count() // (shards * CHUNK_ROWS)))
    placed = placed.select(
        "id", "size", "crc", "row", F.coalesce("own", "shared").alias("shard"),
        F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    placed = materialize(placed, "shard-placed")
    first, firsts, last = 0, [], None
    for r in sorted(placed.groupBy("shard", "chunk").count().collect()):
        first = first if r["shard"] == last else 0
        firsts.append((r["shard"], r["chunk"], first))
        first, last = first + r["count"], r["shard"]
    starts = spark.createDataFrame(firsts, "shard int, chunk int, first long")
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "chunk"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("number") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
