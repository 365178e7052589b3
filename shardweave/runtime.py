"""Where intermediate tables live, and how lineage is cut.

Executors can be lost at any time, so nothing here uses local checkpoints or a
machine's own temp folder on a cluster: tables are written as Parquet under
``spark.checkpoint.dir``, which all machines share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder all machines share: ``spark.checkpoint.dir``.

    Where that is unset and Spark runs in this one process (tests), a temporary
    folder stands in; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="shardweave-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/shardweave/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again; others, and what was derived from settled ones, are left."""
    for t in tables:
        if (path := t.__dict__.get("settled_at")) is not None:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
