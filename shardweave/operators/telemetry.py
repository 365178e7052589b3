"""Run telemetry (O1-O8, F17-F19, H4, H5, D17, D18): timed blocks, log lines into tables, summaries."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardweave.schema import TIMINGS


class Recorder:
    """Collects timed blocks of one process (O1); only in mode 'training'."""

    def __init__(self, rank: int = 0):
        self.rank, self.mode, self.epoch, self.rows, self.seen = rank, "training", 0, [], {}

    @contextmanager
    def block(self, module: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            if self.mode == "training":
                k = (module, self.epoch)
                self.seen[k] = self.seen.get(k, -1) + 1
                self.rows.append((self.rank, module, self.epoch, self.seen[k], (time.perf_counter() - began) * 1000))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, TIMINGS)


def numbers(line: Column) -> Column:
    """The numbers of a log line as doubles (O2)."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"([0-9]+\.[0-9]+|[0-9]+)"), F.lit(1)), lambda x: x.cast("double"))


def parse_log(lines: DataFrame, older: bool = False) -> DataFrame:
    """Lines of (path, world_size, variant, line_no, line) that tell of an epoch, as records.

    Eight numbers: rank, epoch, train loss, validation loss, three accuracies, seconds.
    Seven: rank, world size, epoch, three accuracies, seconds; losses are zero.
    Older: eight, the second the world size. Other counts are left out.
    """
    x = lines.where(F.col("line").contains("Epoch:")).withColumn("n", numbers(F.col("line")))
    eight = F.size("n") == 8
    at = lambda a, b: F.when(eight, F.get("n", F.lit(a))).otherwise(F.get("n", F.lit(b)))
    if older:
        x = x.where(eight)
        cols = {"rank": F.get("n", F.lit(0)), "world_size": F.get("n", F.lit(1)), "epoch": F.get("n", F.lit(2)), "loss": F.get("n", F.lit(3)), "val_loss": F.lit(0.0)}
        rest = {"train_acc": F.get("n", F.lit(4)), "val_acc": F.get("n", F.lit(5)), "test_acc": F.get("n", F.lit(6)), "seconds": F.get("n", F.lit(7))}
    else:
        x = x.where(eight | (F.size("n") == 7))
        zero = lambda a: F.when(eight, F.get("n", F.lit(a))).otherwise(F.lit(0.0))
        cols = {"rank": F.get("n", F.lit(0)), "world_size": F.col("world_size").cast("double"), "epoch": at(1, 2), "loss": zero(2), "val_loss": zero(3)}
        rest = {"train_acc": at(4, 3), "val_acc": at(5, 4), "test_acc": at(6, 5), "seconds": at(7, 6)}
    whole = ("rank", "world_size", "epoch")
    return x.select("variant", "line_no", *[c.cast("int").alias(k) if k in whole else c.alias(k) for k, c in (cols | rest).items()])


def runs(records: DataFrame, epochs: int) -> DataFrame:
    """Records with their run (O7): runs of ``epochs`` lines that follow each other in one log."""
    k = F.row_number().over(Window.partitionBy("world_size", "variant", "rank").orderBy("line_no")) - 1
    return records.withColumn("run", F.floor(k / epochs).cast("long"))


def epoch_time(records: DataFrame) -> DataFrame:
    """(world_size, variant, seconds): the mean over epochs but the first, zero where there are none."""
    mean = F.coalesce(F.avg(F.when(F.col("epoch") > 0, F.col("seconds"))), F.lit(0.0))
    return records.groupBy("world_size", "variant").agg(mean.alias("seconds"))


def epoch_time_wide(records: DataFrame, variants: list[str]) -> DataFrame:
    """A row a world size, a column a variant, in order of world size."""
    return epoch_time(records).groupBy("world_size").pivot("variant", variants).agg(F.first("seconds")).orderBy("world_size")


def accuracy_wide(records: DataFrame, variants: list[str], what: str = "test_acc") -> DataFrame:
    """A row a world size and epoch, a column a variant (O6); the mean where ranks or runs repeat."""
    return records.groupBy("world_size", "epoch").pivot("variant", variants).agg(F.avg(what))


def summary(timings: DataFrame) -> DataFrame:
    """(module, epoch, n, mean_ms, max_ms, min_ms)."""
    ms = F.col("ms")
    return timings.groupBy("module", "epoch").agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"), F.min(ms).alias("min_ms"))


def across_ranks(timings: DataFrame) -> DataFrame:
    """(module, epoch, seq, min, max, mean) over ranks (F17); ranks may differ in how many calls they made."""
    ms = F.col("ms")
    return timings.groupBy("module", "epoch", "seq").agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("mean_ms"))


def best_epochs(records: DataFrame) -> DataFrame:
    """(world_size, variant, best_test, final_test, best_epoch): the best test accuracy, and that of the epoch of least validation loss (H4, Q17)."""
    order = F.struct("val_loss", "epoch")
    return records.groupBy("world_size", "variant").agg(
        F.max("test_acc").alias("best_test"), F.min_by("test_acc", order).alias("final_test"), F.min_by("epoch", order).alias("best_epoch")
    )
