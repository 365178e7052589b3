"""Training logs as they are written: the telemetry operators are the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardweave.operators.telemetry import epoch_time, parse_log
from shardweave.sources.tables import log_lines


def watch(spark: SparkSession, path: str, target: str, checkpoint: str) -> None:
    """Take in the log files of ``path`` that are new since ``checkpoint`` and append their records to ``target``."""
    files = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "stdout*.0").text(path, wholetext=True)
    query = parse_log(log_lines(files)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def summary(spark: SparkSession, target: str) -> DataFrame:
    return epoch_time(spark.read.parquet(target))
