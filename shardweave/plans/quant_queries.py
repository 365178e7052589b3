"""Queries of quantisation and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.functions import quantise as q
from shardweave.operators import exchange
from shardweave.plans import fixtures as fx
from shardweave.plans.fixtures import PARTS, WIDTH, with_graph
from shardweave.plans.graph_queries import _feats, cells, part_assign
from shardweave.plans.registry import query

_PAR = ", par AS (SELECT node_id, min(v) AS zero, CASE WHEN max(v) = min(v) THEN 1 ELSE (max(v) - min(v)) / {levels} END AS scale FROM f GROUP BY node_id)"
_CODES = _PAR + ", code AS (SELECT f.node_id, j, round_even((v - zero) / scale, 0)::INTEGER AS c, zero, scale FROM f JOIN par ON par.node_id = f.node_id)"


def _codes(spark, sf, bits):
    return q.quantise(_feats(spark, sf), F.lit(bits))


@query(with_graph(_PAR.format(levels="255.0") + "SELECT node_id, zero, scale FROM par"))
def quant_params(spark, sf):
    return _codes(spark, sf, 8).select("node_id", "par.zero", "par.scale")


def _code_query(bits):
    @query(with_graph(_CODES.format(levels=f"{2**bits - 1}.0") + "SELECT node_id, j, c FROM code"), f"quant_codes_{bits}")
    def codes(spark, sf):
        return _codes(spark, sf, bits).select("node_id", F.posexplode("code").alias("j", "c"))

    @query(with_graph(_CODES.format(levels=f"{2**bits - 1}.0") + "SELECT node_id, j, round(c * scale + zero, 9) + 0 AS v FROM code"), f"dequant_{bits}")
    def values(spark, sf):
        rows = _codes(spark, sf, bits).select("node_id", q.restore(F.col("code"), F.col("par")).alias("feat"))
        return cells(rows, 9).withColumn("v", F.col("v") + 0.0)

    @query(with_graph(_CODES.format(levels=f"{2**bits - 1}.0") + f"""SELECT node_id // width AS part, (node_id % width) // {8 // bits} AS byte_row, j, bit_or(c << (({8 // bits - 1} - node_id % width % {8 // bits}) * {bits})::INTEGER)::INTEGER AS b
        FROM code, w GROUP BY 1, 2, j"""), f"pack_rows_{bits}")
    def packed(spark, sf):
        rows = _codes(spark, sf, bits).join(part_assign(spark, sf), "node_id")
        return q.pack_down(rows, "part", bits, WIDTH).select("part", "byte_row", F.posexplode("packed").alias("j", "b"))

    @query(with_graph(_CODES.format(levels=f"{2**bits - 1}.0") + "SELECT node_id, j, round(c * scale + zero, 9) + 0 AS v FROM code"), f"unpack_rows_{bits}")
    def unpacked(spark, sf):
        rows = _codes(spark, sf, bits).join(part_assign(spark, sf), "node_id")
        back = q.unpack_down(q.pack_down(rows, "part", bits, WIDTH), rows.select("part", "node_id", "par"), "part", bits)
        return cells(back.select("node_id", "feat"), 9).withColumn("v", F.col("v") + 0.0)


for _bits in q.WIDTHS:
    _code_query(_bits)

_SHARES = {8: 0.25, 4: 0.25, 2: 0.5}
_U = "((node_id * 1103515245 + 12345) % 2147483648) / 2147483648.0"
_BITS = f"SELECT node_id, (CASE WHEN {_U} < 0.25 THEN 8 WHEN {_U} < 0.5 THEN 4 ELSE 2 END)::INTEGER AS num_bits FROM nodes"


def _mixed(spark, sf):
    return q.quantise(_feats(spark, sf), q.assign_bits(F.col("node_id"), _SHARES))


_MIXED = f""", bits AS ({_BITS}),
par AS (SELECT f.node_id, num_bits, min(v) AS zero, CASE WHEN max(v) = min(v) THEN 1 ELSE (max(v) - min(v)) / (pow(2, num_bits) - 1) END AS scale FROM f JOIN bits ON bits.node_id = f.node_id GROUP BY f.node_id, num_bits),
code AS (SELECT f.node_id, j, num_bits, round_even((v - zero) / scale, 0)::INTEGER AS c, zero, scale FROM f JOIN par ON par.node_id = f.node_id)
"""


@query(with_graph(_BITS))
def bits_assign(spark, sf):
    return _feats(spark, sf).select("node_id", q.assign_bits(F.col("node_id"), _SHARES).alias("num_bits"))


@query(with_graph(_MIXED + "SELECT node_id, (j * num_bits // 8)::INTEGER AS i, sum(c << (8 - num_bits - (j * num_bits) % 8)::INTEGER)::INTEGER AS b FROM code GROUP BY node_id, 2"))
def pack_row_mixed(spark, sf):
    return _mixed(spark, sf).select("node_id", F.posexplode(q.pack_big(F.col("code"), F.col("num_bits"), WIDTH)).alias("i", "b"))


@query(with_graph(_MIXED + "SELECT node_id, j, round(c * scale + zero, 9) + 0 AS v FROM code"))
def dequant_roundtrip(spark, sf):
    rows = _mixed(spark, sf).withColumn("packed", q.pack_big(F.col("code"), F.col("num_bits"), WIDTH))
    back = q.unpack_big(F.col("packed"), F.col("num_bits"), WIDTH)
    return cells(rows.select("node_id", q.restore(back, F.col("par")).alias("feat")), 9).withColumn("v", F.col("v") + 0.0)


_LE = ", le AS (SELECT node_id, j, least(greatest(round_even(v / 0.03125 + 8, 0), 0), 15)::INTEGER AS c FROM f)"


@query(with_graph(_LE + "SELECT node_id, (j // 2)::INTEGER AS i, sum(c << ((j % 2) * 4)::INTEGER)::INTEGER AS b FROM le GROUP BY node_id, 2"))
def pack_le(spark, sf):
    packed = q.pack_little(F.col("feat"), F.lit(0.03125), F.lit(8.0), 4, WIDTH)
    return _feats(spark, sf).select("node_id", F.posexplode(packed).alias("i", "b"))


@query(with_graph(_LE + "SELECT node_id, j, (c - 8) * 0.03125::DOUBLE + 0 AS v FROM le"))
def unpack_le(spark, sf):
    packed = q.pack_little(F.col("feat"), F.lit(0.03125), F.lit(8.0), 4, WIDTH)
    rows = _feats(spark, sf).withColumn("packed", packed)
    return cells(rows.select("node_id", q.restore_little(F.col("packed"), F.lit(0.03125), F.lit(8.0), 4, WIDTH).alias("feat"))).withColumn("v", F.col("v") + 0.0)


def _sized(spark, sf):
    return bits_assign(spark, sf).join(part_assign(spark, sf), "node_id")


_SIZED = f", bits AS ({_BITS}), sized AS (SELECT part, bits.node_id, ceil(num_bits * 64 / 8.0)::BIGINT AS size FROM bits JOIN part ON part.node_id = bits.node_id)"


@query(with_graph(_SIZED + " SELECT part, sum(size)::BIGINT AS bytes FROM sized GROUP BY part"))
def byte_splits(spark, sf):
    return exchange.byte_splits(_sized(spark, sf), WIDTH, "part")


@query(with_graph(_SIZED + " SELECT part, node_id, (sum(size) OVER p - size)::BIGINT AS begin, (sum(size) OVER p)::BIGINT AS \"end\" FROM sized WINDOW p AS (PARTITION BY part ORDER BY node_id)"))
def byte_ranges(spark, sf):
    return exchange.byte_ranges(_sized(spark, sf), WIDTH, "part", "node_id")


@query(with_graph("SELECT part, (ceil(count(*) / 4.0) * 64)::BIGINT AS bytes FROM part GROUP BY part"))
def buffer_sizes(spark, sf):
    return part_assign(spark, sf).groupBy("part").agg(q.buffer_size(F.count(F.lit(1)), 2, WIDTH).alias("bytes"))


@query(with_graph("SELECT node_id, j, CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2, floor(log2(abs(v))) - 7), 0) * pow(2, floor(log2(abs(v))) - 7) END + 0 AS v FROM f"))
def bf16_round(spark, sf):
    return cells(fx.nodes(spark, sf).select("node_id", F.transform("feat", q.bfloat16).alias("feat"))).withColumn("v", F.col("v") + 0.0)


assert PARTS == 4  # the SQL above packs four ranks
