"""Exact dedup (8): a streaming aggregate over disk-backed keyed state.

The state (RocksDB, no watermark, so no expiry) holds for each digest of the
normalised text the stable identifier of the row that stays, how many rows
share it, and a locator of that row's content. Files that arrive later are
ingested by another run over the same checkpoint. On hits the full normalised
bytes are compared, so equal digests of different texts (never seen, but
possible) still give exact groups.

Only DataFrame operations run: the stream's partial aggregate combines copies
before the shuffle, so a group that holds a third of all rows is a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardweave.llm.text import whole, without_spaces
from shardweave.runtime import fresh_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition of the state reserves megabytes of disk that it never fills
}


def digest(text: Column) -> Column:
    return F.sha2(without_spaces(whole(text)), 256)


def _better(doc_id: Column, text: Column, *more: Column) -> Column:
    """The greatest of these stays: most code points, then the smallest doc_id (null last)."""
    return F.struct(F.length(whole(text)).alias("chars"), F.bitwise_not(doc_id).alias("id"), *more)


class ExactState:
    """Keyed state in ``checkpoint`` (in the shared folder); survives restarts and lost executors."""

    def __init__(self, spark: SparkSession, checkpoint: str | None = None, max_bytes: int = 64 << 30):
        self.spark, self.max_bytes = spark, max_bytes
        self.checkpoint = checkpoint or fresh_path(spark, "exact-state")

    def ingest(self, path: str, schema: StructType) -> ExactState:
        """Take in the files of ``path`` that the state hasn't seen, at most ``max_bytes`` a micro-batch."""
        before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            place = path.rstrip("/")
            place = f"{place[:-1]}[{place[-1]}]"  # a pattern that only this path fits: a stream's plain path must be a folder, a pattern may be one file
            rows = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(self.max_bytes)).parquet(place)
            locator = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
            state = rows.groupBy(digest(F.col("text")).alias("digest")).agg(
                F.max(_better(F.col("doc_id"), F.col("text"), locator.alias("at"))).alias("best"), F.count(F.lit(1)).alias("n")
            )
            query = state.writeStream.outputMode("update").format("noop").trigger(availableNow=True).option("checkpointLocation", self.checkpoint).start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        query.awaitTermination()
        return self

    def table(self) -> DataFrame:
        """(digest, keep_id, keep_chars, locator, group_size), read from the state itself."""
        raw = self.spark.read.format("statestore").load(self.checkpoint)
        names = {side: [f"{side}.`{f.name}`" for f in raw.schema[side].dataType.fields] for side in ("key", "value")}
        (key,), (best, n) = names["key"], names["value"]
        return raw.select(
            F.col(key).alias("digest"), F.bitwise_not(F.col(f"{best}.id")).alias("keep_id"), F.col(f"{best}.chars").alias("keep_chars"),
            F.col(f"{best}.at").alias("locator"), F.col(n).alias("group_size"),
        )


def exact_groups(spark: SparkSession, path: str, state: ExactState | None = None) -> DataFrame:
    """Every row of the documents at ``path`` with the row that stays in its stead.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when
    identical after deleting [\\x20\\x09-\\x0D]; null counts as empty, and all empty
    texts are one group. The row with the most code points stays, then the
    smallest doc_id; a null doc_id loses ties. Rows that repeat one doc_id and
    length are one document: all of them count and all are marked as kept if it
    stays. An empty table gives an empty result; other columns are not read.
    """
    docs = spark.read.parquet(path).select("doc_id", F.col("text").cast("string").alias("text"))
    table = (state or ExactState(spark)).ingest(path, docs.schema).table()
    hits = table.where("group_size > 1").select("digest", "keep_id", "keep_chars", "group_size")

    keyed = docs.select("doc_id", F.length(whole(F.col("text"))).alias("chars"), digest(F.col("text")).alias("digest"))
    bodies = docs.select("doc_id", F.length(whole(F.col("text"))).alias("chars"), digest(F.col("text")).alias("digest"), without_spaces(whole(F.col("text"))).alias("body"))
    variants = bodies.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("m"))
    clashes = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")

    if not clashes.isEmpty():  # equal digests of different bytes: group these by the bytes themselves
        odd = bodies.join(clashes, "digest", "left_semi")
        best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id")))
        exact = odd.groupBy("digest", "body").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        exact = exact.select("digest", "body", F.bitwise_not("b.id").alias("keep_id"), F.col("b.chars").alias("keep_chars"), "group_size")
        apart = odd.join(exact, ["digest", "body"]).drop("body")
        keyed, hits = keyed.join(clashes, "digest", "left_anti"), hits.join(clashes, "digest", "left_anti")
        found = keyed.join(hits, "digest", "left").unionByName(apart)
    else:
        found = keyed.join(hits, "digest", "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
