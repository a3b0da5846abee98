"""Where jobs put files that several executors read: the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of tables between jobs: a task holds one while it writes or reads.
ROW_GROUP = 8 << 20

#: Paths handed out in this process, for :func:`clean_up`.
_GIVEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set as checkpoint folder.

    Only a local master may go without: one machine's temporary folder is then shared by all its
    threads.  On a cluster it is an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="alnspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/alnspark-{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage that
    survives lost executors, and one evaluation whatever is done with the result."""
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete every path handed out so far and say how many there were.

    Results are read lazily, so call this only when none of this process's results is needed again.
    """
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    paths, _GIVEN[:] = list(_GIVEN), []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)
    return len(paths)
