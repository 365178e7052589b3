"""Queries of log parsing and timings, over log lines made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import telemetry as t
from shardweave.plans import fixtures as fx
from shardweave.plans.registry import query

VARIANTS = ["32bit", "2bit"]

_FIELDS = """SELECT event_id, (event_id % 4)::INTEGER AS rank, (2 << (event_id % 3)::INTEGER)::INTEGER AS world_size, CASE WHEN user_id % 2 = 0 THEN '32bit' ELSE '2bit' END AS variant,
(event_id // 12 % 50)::INTEGER AS epoch, event_id % 7 = 0 AS short,
(event_id * 31 % 997) / 1000.0::DOUBLE AS loss, (event_id * 17 % 991) / 1000.0::DOUBLE AS val_loss, (event_id * 13 % 1000) / 1000.0::DOUBLE AS train_acc,
(event_id * 7 % 1000) / 1000.0::DOUBLE AS val_acc, (event_id * 11 % 1000) / 1000.0::DOUBLE AS test_acc, (500 + event_id * 19 % 1000) / 1000.0::DOUBLE AS seconds FROM events"""
_RECORDS = f"WITH made AS ({_FIELDS}), rec AS (SELECT variant, event_id AS line_no, rank, world_size, epoch, CASE WHEN short THEN 0 ELSE loss END AS loss, CASE WHEN short THEN 0 ELSE val_loss END AS val_loss, train_acc, val_acc, test_acc, seconds FROM made) "


def _lines(spark, sf):
    e = F.col("event_id")
    thousandths = lambda c: F.format_string("%d.%03d", F.floor(c / 1000).cast("long"), c % 1000)
    rank, world, epoch = (e % 4).cast("string"), F.element_at(F.array(*map(F.lit, (2, 4, 8))), (e % 3).cast("int") + 1), F.floor(e / 12 % 50).cast("string")
    acc = [thousandths(e * k % 1000) for k in (13, 7, 11)] + [thousandths(500 + e * 19 % 1000)]
    long = F.concat_ws(", ", F.concat(F.lit("Rank: "), rank), F.concat(F.lit("Epoch: "), epoch), thousandths(e * 31 % 997), thousandths(e * 17 % 991), *acc)
    short = F.concat_ws(", ", F.concat(F.lit("Rank: "), rank), F.concat(F.lit("World: "), world.cast("string")), F.concat(F.lit("Epoch: "), epoch), *acc)
    line = F.when(e % 7 == 0, short).otherwise(long)
    variant = F.when(F.col("user_id") % 2 == 0, "32bit").otherwise("2bit")
    return fx.table(spark, sf, "events").select(F.lit("log").alias("path"), world.alias("world_size"), variant.alias("variant"), e.alias("line_no"), line.alias("line"))


def _records(spark, sf):
    return t.parse_log(_lines(spark, sf))


@query(_RECORDS + "SELECT * FROM rec")
def log_parse(spark, sf):
    return _records(spark, sf)


@query(_RECORDS + "SELECT *, ((row_number() OVER (PARTITION BY world_size, variant, rank ORDER BY line_no) - 1) // 50)::BIGINT AS run FROM rec")
def log_runs(spark, sf):
    return t.runs(_records(spark, sf), 50)


@query(_RECORDS + "SELECT world_size, variant, round(coalesce(avg(seconds) FILTER (WHERE epoch > 0), 0), 9) AS seconds FROM rec GROUP BY world_size, variant")
def epoch_time_avg(spark, sf):
    return t.epoch_time(_records(spark, sf)).withColumn("seconds", F.round("seconds", 9))


@query(_RECORDS + "SELECT world_size, round(avg(seconds) FILTER (WHERE epoch > 0 AND variant = '32bit'), 9) AS \"32bit\", round(avg(seconds) FILTER (WHERE epoch > 0 AND variant = '2bit'), 9) AS \"2bit\" FROM rec GROUP BY world_size")
def epoch_time_pivot(spark, sf):
    out = t.epoch_time_wide(_records(spark, sf), VARIANTS)
    return out.select("world_size", *[F.round(v, 9).alias(v) for v in VARIANTS])


@query(_RECORDS + "SELECT world_size, epoch, round(avg(test_acc) FILTER (WHERE variant = '32bit'), 9) AS \"32bit\", round(avg(test_acc) FILTER (WHERE variant = '2bit'), 9) AS \"2bit\" FROM rec GROUP BY world_size, epoch")
def acc_pivot(spark, sf):
    out = t.accuracy_wide(_records(spark, sf), VARIANTS)
    return out.select("world_size", "epoch", *[F.round(v, 9).alias(v) for v in VARIANTS])


@query(_RECORDS + "SELECT world_size, variant, max(test_acc) AS best_test, arg_min(test_acc, (val_loss, epoch, line_no)) AS final_test, arg_min(epoch, (val_loss, epoch, line_no)) AS best_epoch FROM rec WHERE val_loss > 0 AND rank = 0 GROUP BY world_size, variant")
def best_epoch(spark, sf):
    rows = _records(spark, sf).where("val_loss > 0 AND rank = 0")
    from pyspark.sql import Window

    first = Window.partitionBy("world_size", "variant", "val_loss", "epoch").orderBy("line_no")  # the log's first of equal epochs
    one = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    best = t.best_epochs(one).drop("best_test")
    return best.join(rows.groupBy("world_size", "variant").agg(F.max("test_acc").alias("best_test")), ["world_size", "variant"])


_TIMINGS = "WITH tm AS (SELECT (event_id % 4)::INTEGER AS rank, event_type AS module, (event_id // 4 % 10)::INTEGER AS epoch, (event_id // 40)::INTEGER AS seq, value AS ms FROM events) "


def _timings(spark, sf):
    e = F.col("event_id")
    return fx.table(spark, sf, "events").select((e % 4).cast("int").alias("rank"), F.col("event_type").alias("module"), F.floor(e / 4 % 10).cast("int").alias("epoch"), F.floor(e / 40).cast("int").alias("seq"), F.col("value").alias("ms"))


@query(_TIMINGS + "SELECT module, epoch, count(*)::BIGINT AS n, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms, min(ms) AS min_ms FROM tm GROUP BY module, epoch")
def timing_summary(spark, sf):
    return t.summary(_timings(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(_TIMINGS + "SELECT module, epoch, seq, min(ms) AS min_ms, max(ms) AS max_ms, round(avg(ms), 6) AS mean_ms FROM tm GROUP BY module, epoch, seq")
def timing_ranks(spark, sf):
    return t.across_ranks(_timings(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))
