"""Session helpers shared by every operator: table scans, lineage cuts and size checks.

Lineage is cut with reliable checkpoints or with Parquet tables, both in the folder that the
cluster names in ``spark.checkpoint.dir``; a folder of our own is only used where none is named.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of at most this many bytes may be broadcast; callers prove or measure the size first.
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, set as the context's checkpoint folder.

    Where the session names none, a temporary one is made under a local master; on a cluster, whose
    executors would each write to a disk of their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = named or own_dir(spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(named)
    return named or current.get()


def own_dir(master: str) -> str:
    """A temporary folder of this machine, which only a local master may use."""
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="meridian-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder, partitioned by columns, and read back."""
    path = scratch(df.sparkSession, label)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one go, in whatever file system the path names: beside it first, then renamed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(fresh, where):
        raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
