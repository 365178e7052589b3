"""Queries of cleaning, partitioning, aggregation and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.operators import aggregate as agg
from shardweave.operators import normalise, partition, prep
from shardweave.operators.components import components as label_components
from shardweave.plans import fixtures as fx
from shardweave.plans.fixtures import PARTS, WIDTH, with_graph
from shardweave.plans.registry import query


def cells(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """(node_id, j, v) of feature rows."""
    long = rows.select("node_id", F.posexplode("feat").alias("j", "v"))
    return long.withColumn("v", F.round("v", digits) if digits else F.col("v"))


# Cleaning


@query(with_graph("SELECT src, dst, min(eid)::BIGINT AS eid FROM raw_dense WHERE src <> dst GROUP BY src, dst"))
def edges_clean(spark, sf):
    return prep.clean(fx.raw_edges(spark, sf))


@query(with_graph("SELECT src, dst, eid FROM raw_dense WHERE src = dst"))
def edges_removed_self(spark, sf):
    return prep.self_loops(fx.raw_edges(spark, sf))


_LATER = "SELECT src, dst, eid FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY eid) AS k FROM raw_dense WHERE src <> dst) WHERE k > 1"


@query(with_graph(_LATER))
def edges_removed_dup(spark, sf):
    return prep.later_edges(prep.without_loops(fx.raw_edges(spark, sf)))


@query(with_graph(f"SELECT src, dst, eid, 'loop' AS reason FROM raw_dense WHERE src = dst UNION ALL SELECT src, dst, eid, 'duplicate' FROM ({_LATER})"))
def edges_removed_all(spark, sf):
    return prep.removed(fx.raw_edges(spark, sf))


@query(with_graph("SELECT src, dst FROM dense UNION SELECT dst, src FROM dense"))
def edges_symmetric(spark, sf):
    return prep.symmetrise(fx.edges(spark, sf))


@query(with_graph("SELECT src, dst, min(eid)::BIGINT AS eid FROM (SELECT src, dst, eid FROM raw_dense UNION ALL SELECT dst, src, eid FROM raw_dense) WHERE src <> dst GROUP BY ALL UNION ALL SELECT node_id, node_id, -1 FROM nodes"))
def edges_symmetric_with_loops(spark, sf):
    return prep.clean(fx.raw_edges(spark, sf), symmetric=True, loops=True, nodes=fx.nodes(spark, sf))


@query(with_graph("SELECT src, dst, min(eid)::BIGINT AS eid FROM raw_dense WHERE src <> dst GROUP BY ALL UNION ALL SELECT node_id, node_id, -1 FROM nodes"))
def edges_with_loops(spark, sf):
    return prep.with_loops(prep.clean(fx.raw_edges(spark, sf)), fx.nodes(spark, sf))


@query(with_graph("SELECT src, dst, min(eid)::BIGINT AS eid, 0::BIGINT AS etype FROM raw_dense WHERE src <> dst GROUP BY src, dst"))
def edges_processed(spark, sf):
    return prep.processed(prep.clean(fx.raw_edges(spark, sf)))


_DEGREE = "SELECT node_id, {} AS deg FROM nodes LEFT JOIN (SELECT dst, count(*) AS k FROM {} GROUP BY dst) ON dst = node_id"


@query(with_graph(_DEGREE.format("coalesce(k, 0)::BIGINT", "dense")))
def in_degree(spark, sf):
    return prep.in_degree(fx.nodes(spark, sf), fx.edges(spark, sf))


@query(with_graph(_DEGREE.format("greatest(coalesce(k, 0), 1)::BIGINT", "dense")))
def in_degree_clamped(spark, sf):
    return prep.in_degree(fx.nodes(spark, sf), fx.edges(spark, sf), 1)


@query(with_graph(_DEGREE.format("coalesce(k, 0)::BIGINT", "raw_dense")))
def in_degree_raw(spark, sf):
    return prep.in_degree(fx.nodes(spark, sf), fx.raw_edges(spark, sf))


@query(with_graph("SELECT src AS id, count(*)::BIGINT AS n FROM raw_dense GROUP BY src"))
def id_counts(spark, sf):
    return prep.id_counts(fx.raw_edges(spark, sf), "src")


@query(with_graph("SELECT 0::BIGINT AS node_type, coalesce(k, 0)::BIGINT AS w_in_degree, (split = 'train')::BIGINT AS w_train, 1::BIGINT AS w_one, s.node_id FROM split s LEFT JOIN (SELECT dst, count(*) AS k FROM dense GROUP BY dst) ON dst = s.node_id"))
def node_weights(spark, sf):
    return prep.node_weights(fx.nodes(spark, sf), fx.edges(spark, sf), fx.split(spark, sf).where("split = 'train'"))


@query(with_graph("SELECT (SELECT count(*) FROM nodes)::BIGINT AS num_nodes, (SELECT count(*) FROM dense)::BIGINT AS num_edges, 3::BIGINT AS num_node_weights"))
def graph_stats(spark, sf):
    return prep.graph_stats(fx.nodes(spark, sf), fx.edges(spark, sf))


# Partitioning


@query(with_graph("SELECT node_id, part FROM part"))
def part_assign(spark, sf):
    return partition.assign_ranges(fx.nodes(spark, sf), fx.count(spark, sf), PARTS)


@query(with_graph("SELECT part, min(node_id)::BIGINT AS begin, max(node_id)::BIGINT + 1 AS \"end\" FROM part GROUP BY part"))
def part_bounds(spark, sf):
    return partition.bounds(part_assign(spark, sf))


@query(with_graph("SELECT src, dst, p.part AS src_part FROM dense JOIN part p ON src = node_id"))
def part_owner(spark, sf):
    return partition.owner(fx.edges(spark, sf), "src", part_bounds(spark, sf), "src_part")


@query(with_graph("SELECT node_id, floor(before * 4 / total)::BIGINT AS part FROM (SELECT node_id, coalesce(sum(k) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(k) OVER () AS total FROM (SELECT node_id, coalesce(c, 0) + 1 AS k FROM nodes LEFT JOIN (SELECT dst, count(*) AS c FROM dense GROUP BY dst) ON dst = node_id))"))
def part_balanced(spark, sf):
    return partition.assign_balanced(prep.in_degree(fx.nodes(spark, sf), fx.edges(spark, sf)).withColumnRenamed("deg", "w_in_degree"), PARTS)


_SPLIT = "SELECT src, dst, src // width AS src_part, dst // width AS dst_part, src // width = dst // width AS is_local{} FROM dense, w"


def _split(spark, sf, sparse=False):
    return partition.split_edges(fx.edges(spark, sf, sparse), fx.count(spark, sf), PARTS)


@query(with_graph(_SPLIT.format("")))
def edge_split(spark, sf):
    return _split(spark, sf)


@query(with_graph(_SPLIT.format(", src % width AS src_local, dst % width AS dst_local")))
def edge_localised(spark, sf):
    return partition.localise(fx.edges(spark, sf), fx.count(spark, sf), PARTS)


@query(with_graph("SELECT CASE WHEN src BETWEEN width AND 2 * width - 1 THEN src - width ELSE src END AS src, dst - width AS dst, src BETWEEN width AND 2 * width - 1 AS is_local FROM dense, w WHERE dst // width = 1"))
def edge_split_one_part(spark, sf):
    n = fx.count(spark, sf)
    width = -(-n // PARTS)
    into = fx.edges(spark, sf).where(F.col("dst").between(width, 2 * width - 1))
    return partition.split_by_range(into, width, 2 * width - 1)


def _node_map(spark, sf):
    """New ids in the reverse order of the old."""
    n = fx.count(spark, sf)
    new = fx.nodes(spark, sf).select((F.lit(n - 1) - F.col("node_id")).alias("node_id"), F.col("node_id").alias("orig_id"))
    return new.withColumn("part", partition.part_of(F.col("node_id"), n, PARTS))


@query(with_graph("SELECT t.node_id AS id, (c - 1 - t.node_id) // width AS part, (c - 1 - t.node_id) % width AS local_id FROM split t, n, w WHERE split = 'train'"))
def split_remap(spark, sf):
    return partition.remap(fx.split(spark, sf).where("split = 'train'").select(F.col("node_id").alias("id")), _node_map(spark, sf))


@query(with_graph("SELECT c - 1 - node_id AS node_id, node_id AS orig_id, (c - 1 - node_id) // width AS part, feat, label FROM nodes, n, w"))
def feature_gather(spark, sf):
    return partition.gather(_node_map(spark, sf), fx.nodes(spark, sf))


@query(with_graph("SELECT node_id, CASE WHEN node_id % 3 = 0 THEN -1 ELSE label END AS label FROM nodes"))
def label_clean(spark, sf):
    raw = F.when(F.col("node_id") % 6 == 0, F.lit(float("nan"))).when(F.col("node_id") % 6 == 3, F.lit(None)).otherwise(F.col("label").cast("double"))
    return fx.nodes(spark, sf).select("node_id", partition.clean_label(raw).alias("label"))


@query(with_graph("SELECT s.node_id, split = 'train' AS mask FROM split s"))
def index_mask(spark, sf):
    return partition.mask(fx.nodes(spark, sf).select("node_id"), fx.split(spark, sf).where("split = 'train'"))


@query(with_graph("SELECT count(*)::BIGINT AS edges, count_if(src // width <> dst // width)::BIGINT AS cut FROM dense, w"))
def edge_cut(spark, sf):
    return partition.edge_cut(_split(spark, sf))


@query(with_graph("SELECT part, nodes, in_edges::BIGINT AS in_edges, cut_in::BIGINT AS cut_in FROM (SELECT part, count(*)::BIGINT AS nodes FROM part GROUP BY part) JOIN (SELECT dst // width AS p, count(*) AS in_edges, count_if(src // width <> dst // width) AS cut_in FROM dense, w GROUP BY ALL) ON p = part"))
def part_balance(spark, sf):
    return partition.balance(_split(spark, sf), part_assign(spark, sf))


# Aggregation

_LONG = "SELECT e.dst AS node_id, f.j, {} AS v FROM {} e JOIN f ON f.node_id = e.src GROUP BY e.dst, f.j"


def _feats(spark, sf):
    return fx.nodes(spark, sf).select("node_id", "feat")


@query(with_graph(_LONG.format("sum(v)", "dense")))
def agg_sum(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH))


@query(with_graph(_LONG.format("round(avg(v), 9)", "dense")))
def agg_mean(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH, "mean"), 9)


@query(with_graph(_LONG.format("min(v)", "dense")))
def agg_min(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH, "min"))


@query(with_graph(_LONG.format("max(v)", "dense")))
def agg_max(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH, "max"))


def _powers(spark, sf):
    """Features of one and two, whose products doubles hold exactly."""
    return fx.nodes(spark, sf).select("node_id", F.array(*[(F.lit(1) + (F.col("node_id") + j) % 2).cast("double") for j in range(4)]).alias("feat"))


_POWERS = "SELECT e.dst AS node_id, j::INTEGER AS j, {} AS v FROM dense e, range(4) t(j) GROUP BY e.dst, j"


@query(with_graph(_POWERS.format("product((1 + (src + j) % 2)::DOUBLE)")))
def agg_prod(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _powers(spark, sf), 4, "mul"))


@query(with_graph(_POWERS.format("1 / product((1 + (src + j) % 2)::DOUBLE)")))
def agg_div(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _powers(spark, sf), 4, "div"))


def _weighted(spark, sf):
    return fx.edges(spark, sf).withColumn("w", ((F.col("src") + 2 * F.col("dst")) % 4 + 1).cast("double") / 4)


@query(with_graph(_LONG.format("sum(v * ((e.src + 2 * e.dst) % 4 + 1)::DOUBLE / 4)", "dense")))
def agg_weighted(spark, sf):
    return cells(agg.aggregate(_weighted(spark, sf), _feats(spark, sf), WIDTH, "sum", "w"))


@query(with_graph("SELECT e.src AS node_id, f.j, sum(v) AS v FROM dense e JOIN f ON f.node_id = e.dst GROUP BY e.src, f.j"))
def agg_transpose(spark, sf):
    return cells(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH, by="src"))


@query(with_graph("SELECT n.node_id, j::INTEGER AS j, coalesce(v, 0) AS v FROM nodes n CROSS JOIN range(64) t(j) LEFT JOIN (SELECT e.dst, f.j AS k, sum(v) AS v FROM dense e JOIN f ON f.node_id = e.src GROUP BY ALL) ON dst = n.node_id AND k = j"))
def agg_dense(spark, sf):
    return cells(agg.dense(fx.nodes(spark, sf), agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH), WIDTH))


@query(with_graph("SELECT node_id, j, sum(v) AS v FROM (SELECT e.dst AS node_id, f.j, f.v FROM dense e JOIN f ON f.node_id = e.src UNION ALL SELECT node_id, j, v * k FROM f, range(1, 4) t(k) WHERE node_id % 2 = 0 OR k = 3) GROUP BY ALL"))
def scatter_add(spark, sf):
    """Sums, and rows that repeat a node: one for odd nodes, three for even ones."""
    own = _feats(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).where("node_id % 2 = 0 OR k = 3")
    more = own.select("node_id", F.transform("feat", lambda x: x.cast("double") * F.col("k")).alias("feat"))
    return cells(agg.add(agg.aggregate(fx.edges(spark, sf), _feats(spark, sf), WIDTH), more, WIDTH))


_ARG = "SELECT dst AS node_id, arg_{}(eid, (v, {}))::BIGINT AS eid FROM (SELECT src, dst, min(eid) AS eid FROM raw_dense WHERE src <> dst GROUP BY ALL) e JOIN f ON f.node_id = e.src AND j = 0 GROUP BY dst"


@query(with_graph(_ARG.format("min", "eid")))
def agg_arg_min(spark, sf):
    return agg.arg_reduce(prep.clean(fx.raw_edges(spark, sf)), _feats(spark, sf), 0, False)


@query(with_graph(_ARG.format("max", "-eid")))
def agg_arg_max(spark, sf):
    return agg.arg_reduce(prep.clean(fx.raw_edges(spark, sf)), _feats(spark, sf), 0, True)


_SDDMM = "SELECT src, dst, round(sum(a.v * b.v){}, 6) + 0 AS v FROM dense JOIN f a ON a.node_id = src JOIN f b ON b.node_id = dst AND a.j = b.j {} GROUP BY src, dst{}"


@query(with_graph(_SDDMM.format("", "", "")))
def sddmm(spark, sf):
    return agg.sampled_products(fx.edges(spark, sf), _feats(spark, sf), _feats(spark, sf)).withColumn("v", F.round("v", 6) + 0.0)


@query(with_graph(_SDDMM.format(" / d", "JOIN (SELECT dst AS k, count(*) AS d FROM dense GROUP BY dst) ON k = dst", ", d")))
def sddmm_mean(spark, sf):
    return agg.sampled_products(fx.edges(spark, sf), _feats(spark, sf), _feats(spark, sf), True).withColumn("v", F.round("v", 6) + 0.0)


@query(with_graph("SELECT dst AS node_id, sum(((src + 2 * dst) % 4 + 1)::DOUBLE / 4) AS flops FROM dense GROUP BY dst"))
def flops_per_row(spark, sf):
    return agg.flops(_weighted(spark, sf), "w")


# Normalisation

_NORM = """, {d}deg AS (SELECT node_id, count(e.dst) AS d FROM nodes LEFT JOIN {e} e ON e.dst = node_id GROUP BY node_id),
{d}norm AS (SELECT src, dst, (CASE WHEN a.d > 0 THEN pow(a.d, -0.5) ELSE 0 END) * (CASE WHEN b.d > 0 THEN pow(b.d, -0.5) ELSE 0 END) AS w FROM {e} JOIN {d}deg a ON a.node_id = src JOIN {d}deg b ON b.node_id = dst)
"""
_LOOPED = ", looped AS (SELECT src, dst FROM dense UNION ALL SELECT node_id, node_id FROM nodes)"


def _norm(spark, sf, loops):
    e, nodes = fx.edges(spark, sf), fx.nodes(spark, sf)
    return normalise.symmetric(normalise.unit_loops(e, nodes) if loops else e, nodes)


@query(with_graph(_NORM.format(d="p", e="dense") + "SELECT src, dst, round(w, 9) AS w FROM pnorm"))
def gcn_norm_weights(spark, sf):
    return _norm(spark, sf, False).withColumn("w", F.round("w", 9))


@query(with_graph(_LOOPED + _NORM.format(d="q", e="looped") + "SELECT src, dst, round(w, 9) AS w FROM qnorm"))
def gcn_norm_selfloop(spark, sf):
    return _norm(spark, sf, True).withColumn("w", F.round("w", 9))


_HOPS = """, h1 AS (SELECT dst AS node_id, j, sum(v * w) AS v FROM {d}norm JOIN f ON f.node_id = src GROUP BY ALL),
h2 AS (SELECT dst AS node_id, j, sum(v * w) AS v FROM {d}norm JOIN h1 ON h1.node_id = src GROUP BY ALL)
SELECT n.node_id, t.j::INTEGER AS j, round(coalesce(v, 0), 6) + 0 AS v FROM nodes n CROSS JOIN range(64) t(j) LEFT JOIN h2 ON h2.node_id = n.node_id AND h2.j = t.j"""


def _hops(spark, sf, loops):
    out = agg.k_hop(_norm(spark, sf, loops), _feats(spark, sf), fx.nodes(spark, sf), WIDTH, 2, "w")[-1]
    return cells(out, 6).withColumn("v", F.col("v") + 0.0)


@query(with_graph(_NORM.format(d="p", e="dense") + _HOPS.format(d="p")))
def khop_2_noloop(spark, sf):
    return _hops(spark, sf, False)


@query(with_graph(_LOOPED + _NORM.format(d="q", e="looped") + _HOPS.format(d="q")))
def khop_2_loop(spark, sf):
    return _hops(spark, sf, True)


@query(with_graph("SELECT node_id, j, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12), 6) + 0 AS v FROM f"))
def l2_norm(spark, sf):
    return cells(fx.nodes(spark, sf).select("node_id", normalise.l2(F.col("feat")).alias("feat")), 6).withColumn("v", F.col("v") + 0.0)


@query(with_graph("SELECT node_id, j, round((v - avg(v) OVER p) / sqrt(var_pop(v) OVER p + 1e-5), 6) + 0 AS v FROM f WINDOW p AS (PARTITION BY node_id)"))
def layer_norm(spark, sf):
    return cells(fx.nodes(spark, sf).select("node_id", normalise.layer_norm(F.col("feat"), WIDTH).alias("feat")), 6).withColumn("v", F.col("v") + 0.0)


@query(with_graph("SELECT node_id, j, round((v - avg(v) OVER p) / stddev_samp(v) OVER p, 6) + 0 AS v FROM f WINDOW p AS (PARTITION BY j)"))
def batch_norm_local(spark, sf):
    return cells(normalise.batch_norm(_feats(spark, sf), WIDTH), 6).withColumn("v", F.col("v") + 0.0)


@query(with_graph("SELECT node_id, j, round((v - avg(v) OVER p) / sqrt(avg(v * v) OVER p - pow(avg(v) OVER p, 2) + 1e-5), 6) + 0 AS v FROM f WINDOW p AS (PARTITION BY j)"))
def batch_norm_global(spark, sf):
    return cells(normalise.batch_norm(_feats(spark, sf), WIDTH, False), 6).withColumn("v", F.col("v") + 0.0)


@query(with_graph("SELECT j, round(avg(v), 9) AS mean, round(avg(v * v), 9) AS square FROM f GROUP BY j"))
def column_moments(spark, sf):
    m = normalise.moments(_feats(spark, sf), WIDTH)
    return m.select("j", F.round("mean", 9).alias("mean"), F.round("square", 9).alias("square"))


@query(with_graph(_NORM.format(d="p", e="dense") + "SELECT node_id, round(v / d, 9) + 0 AS v, j FROM (SELECT dst, j, sum(v) AS v FROM dense JOIN f ON f.node_id = src GROUP BY ALL) JOIN pdeg ON node_id = dst"))
def degree_mean(spark, sf):
    e = fx.edges(spark, sf)
    rows = agg.aggregate(e, _feats(spark, sf), WIDTH)
    return cells(normalise.by_degree(rows, prep.in_degree(fx.nodes(spark, sf), e, 1)), 9).withColumn("v", F.col("v") + 0.0)


_REACH = ", both_ways AS (SELECT src, dst FROM dense UNION SELECT dst, src FROM dense), reach(node, other) AS (SELECT src, src FROM both_ways UNION SELECT node, dst FROM reach JOIN both_ways ON src = other)"


@query(with_graph(_REACH + " SELECT node, min(other)::BIGINT AS component FROM reach GROUP BY node"))
def components(spark, sf):
    return label_components(fx.edges(spark, sf))
