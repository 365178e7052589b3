"""Line dedup (1): levelled sorted runs of line hashes.

Line keys are hashed to 128 bits and counted by batch; batches are ranges of
descending doc_id. A batch merge-anti-joins the runs, which drops keys whose
fate the runs have settled (in enough documents already, the largest doc_id
known), and what is left becomes a sorted run of its own. When a level holds
``fanout`` runs they are merged into one of the next level.

Only DataFrame operations run. A line that very many documents hold is one row
a task after the partial aggregate; where lines meet the settled keys, the
join is one that adaptive execution splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.llm.text import lower_ascii, strip, whole
from shardweave.runtime import fresh_path, remove, settle

KEY = ["__h1", "__h2"]
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """(pos, h1, h2) for the lines whose key is long enough."""
    keys = F.transform(_lines(text), lambda line: lower_ascii(strip(line)))
    keyed = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("pos"), k.alias("key"))), lambda x: F.length(x["key"]) >= min_chars)
    return F.transform(keyed, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("line"), x["key"]).alias("h2")))


class LineRuns:
    """Sorted runs of (hash, documents, largest doc_id), by level, in the shared folder.

    A run is a table bucketed by the hash, each bucket in its order; runs have
    equal buckets, as many as the session has shuffle partitions. So a batch
    that is dealt by the hash meets all runs in merge joins that neither shuffle
    nor sort them.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        """Scans tell the planner that their buckets are in order."""
        before = self.spark.conf.get(_ORDER, "false")
        self.spark.conf.set(_ORDER, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDER, before)

    def _write(self, run: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"line-run-{level}")
        name = f"line_run_{uuid.uuid4().hex}"
        with self._ordered():
            run.write.format("parquet").options(compression="zstd", path=path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [*self.levels[level], (name, path)]

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def _merge(self, runs: list[tuple[str, str]]) -> DataFrame:
        """All runs as one, dealt by the hash; read as plain files, as a union of bucketed scans is not itself bucketed."""
        schema = "__h1 long, __h2 long, __n long, __last long"
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(path) for _, path in runs))
        return rows.groupBy(*KEY).agg(F.sum("__n").alias("__n"), F.max("__last").alias("__last"))

    def add(self, counted: DataFrame) -> None:
        """Add a batch of (hash, documents, largest doc_id), less the keys whose fate the runs have settled; batches come in descending doc_id."""
        known = F.lit(0)
        if not any(self.levels):
            counted = counted.repartition(self.buckets, *KEY)
        for i, (name, _) in enumerate(run for level in self.levels for run in level):
            run = self.spark.table(name).select(*KEY, F.col("__n").alias(f"__n{i}"))
            counted = counted.join(run.hint("merge"), KEY, "left")
            known = known + F.coalesce(f"__n{i}", F.lit(0))
        self._write(counted.where(known < self.min_docs).select(*KEY, "__n", "__last"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merge(old), level + 1)
            self._drop(old)
            level += 1

    def settled(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the largest doc_id that holds each, as a table; the runs go."""
        runs = [run for level in self.levels for run in level]
        with self._ordered():
            out = settle(self._merge(runs).where(F.col("__n") >= self.min_docs), "common-lines")
        self._drop(runs)
        return out


def _batch(docs: DataFrame, n: int) -> Column:
    """The number of a row's batch: ranges of descending doc_id, of about equal size; null doc_ids come last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    return F.coalesce(reduce(lambda c, cut: c + (F.col("doc_id") <= cut).cast("int"), cuts, F.lit(0)), F.lit(len(cuts)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3, batch_rows: int = 100_000_000) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with ``__n_lines``, ``__n_dropped`` and ``__kept``, the text that stays.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. Keys
    of ``min_chars`` code points or more that ``min_docs`` documents hold lose all
    lines but those in the largest doc_id. A null or empty text is one empty
    line. Every row counts as a document; rows that repeat a doc_id are decided
    by that doc_id alike, and a null doc_id is smaller than any other. If all
    lines go, the text is empty. Other columns pass through whatever their name;
    columns named as the three that are added give way to them. There are
    ``batches``, or one for each ``batch_rows`` rows and four at least; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = batches or max(4, -(-narrow.count() // batch_rows))
    held = F.array_distinct(F.transform(_hashes(F.col("text"), min_chars), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    rows = narrow.select("doc_id", _batch(narrow, n).alias("__batch"), F.explode(held).alias("h"))
    counted = rows.groupBy("__batch", F.col("h.h1").alias("__h1"), F.col("h.h2").alias("__h2")).agg(F.count(F.lit(1)).alias("__n"), F.max("doc_id").alias("__last"))
    at = fresh_path(spark, "line-keys")  # texts are hashed once; a batch reads its own folder
    counted.write.partitionBy("__batch").option("compression", "zstd").parquet(at)
    keys = spark.read.schema("__h1 long, __h2 long, __n long, __last long, __batch int").parquet(at)
    for i in range(n):
        runs.add(keys.where(F.col("__batch") == i).drop("__batch"))

    row = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(whole(F.col("text"))).alias("__row")]
    lines = narrow.select(*row, F.explode(_hashes(F.col("text"), min_chars)).alias("h"))
    lines = lines.select("__id", "__row", F.col("h.pos").alias("__pos"), F.col("h.h1").alias("__h1"), F.col("h.h2").alias("__h2"))
    common = runs.settled()  # a table, not an aggregate: only between plain shuffles are large partitions split
    remove(spark, at)
    gone = lines.join(common, KEY).where(~F.col("__id").eqNullSafe(F.col("__last")))
    gone = gone.groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__gone"))
    gone = gone.select(F.col("__id").alias("__gid"), F.col("__row").alias("__grow"), "__gone")

    own = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped", "__kept")]
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__doc"), F.col("text").alias("__text"), *row)  # one column, so that no name can clash
    found = every.join(gone, every["__id"].eqNullSafe(gone["__gid"]) & (every["__row"] == gone["__grow"]), "left")
    n = F.size("__lines")
    found = found.withColumn("__lines", _lines(F.col("__text"))).withColumn("__stay", F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__gone", F.array().cast("array<int>"))))
    found = found.withColumns(
        {
            "__n_lines": n.cast("long"),
            "__n_dropped": (n - F.size("__stay")).cast("long"),
            "__kept": F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n"),
        }
    )
    return found.select("__doc.*", "__n_lines", "__n_dropped", "__kept")
