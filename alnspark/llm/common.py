"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import materialize, shared_path

__all__ = ["annotate", "by_place", "column", "crc_bucket", "fresh", "labelled_sample", "lookup", "materialize", "release", "scratch", "small_batches",
           "texts_of"]

#: Rows handled at once inside a Python worker; an Arrow batch itself is bounded by Spark (64 MB
#: unless ``spark.sql.execution.arrow.maxBytesPerBatch`` says otherwise).
SLICE = 256

#: Rows and bytes of an Arrow batch that the registered queries and the pipeline ask for.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20

#: A key is hot if it holds more than one in so many rows.
HOT_KEYS = 4096
#: Bytes of text of each class that a model is fitted on, at most: bounds the driver's memory.
SAMPLE_BYTES = 16 << 20

scratch = shared_path


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes, where the session leaves
    the defaults of 10,000 and 64 MB.  Buffers of a batch are held by the JVM and by the worker.

    For jobs, not operators: the registered queries and the stages of the pipeline call it, as their
    session is theirs to configure; no operator changes the session it is used in.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def release() -> None:
    """Give memory that is free by now back to the system.  Python workers live on between tasks, and
    what they once needed would be lacking to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing is lost
        pass


def column(name: str) -> Column:
    """A column by its whole name, whatever marks the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def by_place(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns under names of their places, so that no name can clash with another."""
    return df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def annotate(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[Any]], Sequence[Any]]],
    fields: list[T.StructField],
    keep: Sequence[str] | None = None,
    nulls: bool = False,
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, without a shuffle.

    An input column named like a new one (ignoring case) gives way to it.

    ``make`` runs once per task and gives a function from a list of texts to one value list per
    field.  ``keep`` names the input columns to pass through (default: all).  With ``nulls`` the
    function sees null texts as None, else as empty texts.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    out = T.StructType([df.schema[c] for c in kept] + fields)
    source = by_place(df, [text_col, *kept])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(0).to_pylist() if nulls else texts_of(part.column(0))
                values = [pa.array(v, t) for v, t in zip(fn(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays(list(part.columns[1:]) + values, names=names)
        del fn
        release()

    return source.mapInArrow(run, out)


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and in ``count``
    how many of the ``total`` rows have that key.

    Keys with more than one in ``HOT_KEYS`` of the rows are fewer than ``HOT_KEYS``; they are
    broadcast, so that no task gets all rows of one.  The others meet by a shuffle.
    """
    hot = F.col(count) > max(total // HOT_KEYS, 1)
    often = F.broadcast(table.filter(hot).drop(count))
    by_broadcast = rows.join(often, key)
    by_shuffle = rows.join(often.select(key), key, "left_anti").join(table.filter(~hot).drop(count), key)
    return by_broadcast.unionByName(by_shuffle)


def crc_bucket(name: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column(name).cast("string"), F.lit(""))) % F.lit(modulus)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    exclude=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(id, text, y): at most ``per_class`` labelled documents and ``most_bytes`` of text of each class.

    Ids are taken in the order of a hash; one whose text would go beyond the bytes is passed over.
    ``exclude`` is a boolean column over the id: rows where it holds are never used.  Ids labelled
    more than once count with their largest label; labels other than 0 and 1 are ignored.  Of an id
    that stands in several rows the shortest text counts, of equally long ones the first in order.
    Only picked ids (a documented bound) are broadcast; the texts of picked ids alone are shuffled,
    one of each id from each task.
    """
    rows = labels.select(column(id_col).alias("id"), column(label).cast("int").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    if exclude is not None:
        rows = rows.filter(~exclude("id"))
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    spark, id_type = docs.sparkSession, labels.schema[id_col].dataType
    schema = T.StructType([T.StructField("__id", id_type), T.StructField("y", T.IntegerType())])

    def joined(table: DataFrame, picked: list) -> DataFrame:
        ids = F.broadcast(spark.createDataFrame(picked, schema))
        return table.join(ids, F.col("id").eqNullSafe(F.col("__id"))).drop("__id")

    picked: list = []
    for y in (0, 1):
        own = rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked += [(r["id"], r["y"]) for r in own.collect()]
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("t")
    found = materialize(joined(texts, picked).groupBy("id", "y").agg(least).select("id", "t.text", "y", "t.n"), "sample")
    size = {r["id"]: r["n"] for r in found.select("id", "n").collect()}
    left, kept = {0: most_bytes, 1: most_bytes}, []
    for i, y in picked:
        if i in size and size[i] <= left[y]:
            left[y] -= size[i]
            kept.append((i, y))
    return joined(found.drop("y", "n"), kept)
