"""Queries of exchange planning and of aggregation under each plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.functions.codec import PLAIN, choose_codec
from shardweave.operators import exchange
from shardweave.operators.cover import covers
from shardweave.plans import fixtures as fx
from shardweave.plans.fixtures import PARTS, WIDTH, with_graph
from shardweave.plans.graph_queries import _feats, _split, cells, part_assign
from shardweave.plans.registry import query
from shardweave.runtime import settle


def _cut(spark, sf, sparse=False):
    return exchange.cut_edges(_split(spark, sf, sparse)).select("src", "dst", "src_part", "dst_part")


def _degree(cut: str) -> str:
    return f""", counted AS (SELECT *, count(*) OVER (PARTITION BY src_part, dst_part, src) AS o, count(*) OVER (PARTITION BY src_part, dst_part, dst) AS i FROM {cut}),
by_degree AS (SELECT src, dst, src_part, dst_part, CASE WHEN o > i THEN 'post' ELSE 'pre' END AS mode FROM counted)
"""


_DEGREE, _DEGREE_SPARSE = _degree("cut"), _degree("cut_sparse")


@query(with_graph("SELECT DISTINCT src_part, dst_part, src FROM cut"))
def demand_set(spark, sf):
    return exchange.demand(_cut(spark, sf))


@query(with_graph(_DEGREE + "SELECT * FROM by_degree"))
def plan_degree(spark, sf):
    return exchange.degree_modes(_cut(spark, sf))


def _listed(rows: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY {order}) - 1 AS at FROM ({rows})"


@query(with_graph(_DEGREE + _listed("SELECT src_part, dst_part, src, dst FROM by_degree WHERE mode = 'pre' UNION ALL SELECT DISTINCT src_part, dst_part, src, src FROM by_degree WHERE mode = 'post'", "dst, src")))
def send_list(spark, sf):
    return exchange.sent(plan_degree(spark, sf))


@query(with_graph(_DEGREE + _listed("SELECT src_part, dst_part, src, dst FROM by_degree WHERE mode = 'post' UNION ALL SELECT DISTINCT src_part, dst_part, dst, dst FROM by_degree WHERE mode = 'pre'", "src, dst")))
def recv_list(spark, sf):
    return exchange.received(plan_degree(spark, sf))


_VOLUME = "SELECT a.x AS src_part, b.x AS dst_part, coalesce(k, 0)::BIGINT AS n_rows, ceil(coalesce(k, 0) * 8 / 8.0)::BIGINT AS packed_8, ceil(coalesce(k, 0) * 4 / 8.0)::BIGINT AS packed_4, ceil(coalesce(k, 0) * 2 / 8.0)::BIGINT AS packed_2 FROM range(4) a(x) CROSS JOIN range(4) b(x) LEFT JOIN (SELECT src_part, dst_part, count(DISTINCT CASE mode WHEN 'pre' THEN -1 - dst ELSE src END) AS k FROM by_degree GROUP BY ALL) ON src_part = a.x AND dst_part = b.x"


@query(with_graph(_DEGREE_SPARSE + _VOLUME))
def comm_splits(spark, sf):
    return exchange.volumes(exchange.degree_modes(_cut(spark, sf, True)), PARTS)


@query(with_graph(_DEGREE_SPARSE + f", vol AS ({_VOLUME}) SELECT s.part, sent, received FROM (SELECT src_part AS part, sum(n_rows)::BIGINT AS sent FROM vol GROUP BY 1) s JOIN (SELECT dst_part AS part, sum(n_rows)::BIGINT AS received FROM vol GROUP BY 1) r ON s.part = r.part"))
def comm_volume(spark, sf):
    return exchange.part_volumes(comm_splits(spark, sf))


@query(with_graph(_DEGREE_SPARSE + f", vol AS ({_VOLUME}) SELECT dst_part, src_part, (sum(n_rows) OVER p - n_rows)::BIGINT AS begin, (sum(n_rows) OVER p)::BIGINT AS \"end\" FROM vol WINDOW p AS (PARTITION BY dst_part ORDER BY src_part)"))
def prefix_ranges(spark, sf):
    return exchange.ranges(comm_splits(spark, sf))


@query(with_graph("SELECT dst_part, src, dst, dense_rank() OVER (PARTITION BY dst_part ORDER BY src) - 1 + k AS remote_id FROM cut JOIN (SELECT part, count(*) AS k FROM part GROUP BY part) ON part = dst_part"))
def remote_renumber(spark, sf):
    nodes = part_assign(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    return exchange.renumber(_cut(spark, sf), nodes)


@query(with_graph("SELECT src_part, dst, dense_rank() OVER (ORDER BY src_part, dst) - 1 AS new_id FROM cut"))
def remap_ids(spark, sf):
    return exchange.remap_ids(_cut(spark, sf).select("src_part", "dst"), "src_part", "dst")


# One answer under every plan

_SUM = with_graph("SELECT e.dst AS node_id, f.j, sum(v) AS v FROM dense e JOIN f ON f.node_id = e.src GROUP BY e.dst, f.j")


def _planned(spark, sf, modes, codec=PLAIN):
    """The cut and its plan are written once, as every branch reads them."""
    split = _split(spark, sf)
    planned = settle(modes(exchange.cut_edges(split).select("src", "dst", "src_part", "dst_part")), "planned")
    rows = exchange.aggregate_planned(split.where("is_local"), planned, _feats(spark, sf), WIDTH, codec=codec)
    return cells(rows) if codec is PLAIN else cells(rows, 6).withColumn("v", F.col("v") + 0.0)


@query(_SUM)
def agg_plan_pre(spark, sf):
    return _planned(spark, sf, lambda cut: exchange.constant_modes(cut, "pre"))


@query(_SUM)
def agg_plan_post(spark, sf):
    return _planned(spark, sf, lambda cut: exchange.constant_modes(cut, "post"))


@query(_SUM)
def agg_plan_degree(spark, sf):
    return _planned(spark, sf, exchange.degree_modes)


@query(_SUM)
def agg_plan_cover(spark, sf):
    return _planned(spark, sf, exchange.cover_modes)


# Packed exchange: what crosses is what its codes restore, what stays is exact

_CROSSING = _DEGREE + """, pre AS (SELECT src_part AS place, dst AS node_id, f.j, sum(v) AS v FROM by_degree JOIN f ON f.node_id = src WHERE mode = 'pre' GROUP BY ALL),
post AS (SELECT DISTINCT dst_part AS place, src AS node_id, f.j, f.v FROM by_degree JOIN f ON f.node_id = src WHERE mode = 'post'),
own AS (SELECT dst AS node_id, f.j, sum(v) AS v FROM dense JOIN f ON f.node_id = src, w WHERE src // width = dst // width GROUP BY ALL),
"""
_RESTORED = "SELECT place, node_id, j, {value} AS v FROM (SELECT *, min(v) OVER q AS zero, max(v) OVER q AS top, {bits} AS bits FROM {rows} WINDOW q AS (PARTITION BY place, node_id))"
_AFFINE = "round_even((v - zero) / CASE WHEN top = zero THEN 1 ELSE (top - zero) / (pow(2, bits) - 1) END, 0) * CASE WHEN top = zero THEN 1 ELSE (top - zero) / (pow(2, bits) - 1) END + zero"
_HALF = "CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(2, floor(log2(abs(v))) - 7), 0) * pow(2, floor(log2(abs(v))) - 7) END"
_DRAWN = "CASE WHEN ((node_id * 1103515245 + 12345) % 2147483648) / 2147483648.0 < 0.25 THEN 8 WHEN ((node_id * 1103515245 + 12345) % 2147483648) / 2147483648.0 < 0.5 THEN 4 ELSE 2 END"


def _packed_sql(value: str, bits: str) -> str:
    restored = {r: _RESTORED.format(value=value, bits=bits, rows=r) for r in ("pre", "post")}
    return with_graph(_CROSSING + f"pre2 AS ({restored['pre']}), post2 AS ({restored['post']}), every AS (SELECT * FROM own UNION ALL SELECT node_id, j, v FROM pre2 UNION ALL SELECT dst, j, v FROM by_degree JOIN post2 ON place = dst_part AND node_id = src WHERE mode = 'post') SELECT node_id, j, round(sum(v), 6) + 0 AS v FROM every GROUP BY node_id, j")


def _packed_query(name: str, codec, sql: str):
    @query(sql, name)
    def packed(spark, sf):
        return _planned(spark, sf, exchange.degree_modes, codec)


for _bits in (8, 4, 2):
    _packed_query(f"agg_plan_int{_bits}", choose_codec(_bits), _packed_sql(_AFFINE, str(_bits)))
_packed_query("agg_plan_bf16", choose_codec(16), _packed_sql(_HALF, "16"))
_packed_query("agg_plan_mixed", choose_codec(32, shares={8: 0.25, 4: 0.25, 2: 0.5}), _packed_sql(_AFFINE, _DRAWN))


# Covers


@query()
def cover_size(spark, sf):
    """Rows that cross for each part pair under a minimum cover; the set isn't unique, its size is."""
    return covers(_cut(spark, sf, True)).groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("size"))


@query("SELECT 0::BIGINT AS uncovered")
def cover_valid(spark, sf):
    cut = settle(_cut(spark, sf), "cut")
    cover = settle(covers(cut), "cover")
    for side in ("src", "dst"):
        held = cover.where(F.col("side") == side).select("src_part", "dst_part", F.col("node").alias(side))
        cut = cut.join(held, ["src_part", "dst_part", side], "left_anti")
    return cut.agg(F.count(F.lit(1)).alias("uncovered"))


@query()
def plan_cover(spark, sf):
    return exchange.cover_modes(_cut(spark, sf, True))


@query()
def plan_cover_volume(spark, sf):
    """Rows that cross in all, by plan: the cover's are the least."""
    cut = _cut(spark, sf, True)
    plans = {"cover": exchange.cover_modes(cut), "degree": exchange.degree_modes(cut), "post": exchange.constant_modes(cut, "post"), "pre": exchange.constant_modes(cut, "pre")}
    out = None
    for name, planned in plans.items():
        one = exchange.messages(planned).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("plan"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
