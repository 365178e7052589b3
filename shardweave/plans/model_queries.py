"""Queries of layers, losses, masks, sampling and training; weights come from a formula that SQL can evaluate too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shardweave.functions import dense as d
from shardweave.operators import aggregate as agg
from shardweave.operators import gnn, model, sampling
from shardweave.plans import fixtures as fx
from shardweave.plans.fixtures import WIDTH, with_graph
from shardweave.plans.graph_queries import _LOOPED, _NORM, _feats, _norm, _weighted, cells
from shardweave.plans.registry import query
from shardweave.runtime import settle

OUT = 8


def weights(into: int, out: int, a: int) -> np.ndarray:
    k, j = np.mgrid[:into, :out]
    return ((k * 7 + j * 3 + a) % 11 - 5) / 10.0


def bias(out: int) -> np.ndarray:
    return np.arange(out) / 10.0


def _w(a: int, out: int = OUT, into: int = WIDTH) -> str:
    return f"(SELECT k::INTEGER AS k, o::INTEGER AS o, ((k * 7 + o * 3 + {a}) % 11 - 5) / 10.0::DOUBLE AS w FROM range({into}) a(k), range({out}) b(o))"


def _signless(rows):
    return cells(rows, 6).withColumn("v", F.col("v") + 0.0)


_CTE = f""", w1 AS {_w(1)}, w2 AS {_w(2)}, deg AS (SELECT node_id, count(e.dst) AS dg FROM nodes LEFT JOIN dense e ON e.dst = node_id GROUP BY node_id),
total AS (SELECT n.node_id, t.j::INTEGER AS j, coalesce(s, 0) AS s FROM nodes n CROSS JOIN range(64) t(j) LEFT JOIN (SELECT dst, f.j AS jj, sum(v) AS s FROM dense JOIN f ON f.node_id = src GROUP BY ALL) ON dst = n.node_id AND jj = t.j),
image AS (SELECT node_id, o AS j, sum(v * w) + o / 10.0 AS v FROM f JOIN w1 ON k = f.j GROUP BY node_id, o)
"""


@query(with_graph(_CTE + "SELECT node_id, j, round(v, 6) + 0 AS v FROM image"))
def dense_fixed_w(spark, sf):
    return _signless(d.linear(_feats(spark, sf), weights(WIDTH, OUT, 1), bias(OUT)))


@query(with_graph(_CTE + "SELECT node_id, j, round(greatest(v, 0), 6) + 0 AS v FROM image"))
def relu(spark, sf):
    return _signless(d.linear(_feats(spark, sf), weights(WIDTH, OUT, 1), bias(OUT)).select("node_id", d.relu(F.col("feat")).alias("feat")))


_LOGP = _CTE + ", logp AS (SELECT node_id, j, v - max(v) OVER p - ln(sum(exp(v)) OVER p) + max(v) OVER p AS v FROM image WINDOW p AS (PARTITION BY node_id))"


def _logp(spark, sf):
    return d.linear(_feats(spark, sf), weights(WIDTH, OUT, 1), bias(OUT)).select("node_id", d.softmax_log(F.col("feat")).alias("feat"))


@query(with_graph(_LOGP + "SELECT node_id, j, round(v, 6) + 0 AS v FROM logp"))
def log_softmax(spark, sf):
    return _signless(_logp(spark, sf))


@query(with_graph(_CTE + """SELECT t.node_id, a.o AS j, round(sum(s / greatest(dg, 1) * b.w + v * a.w) + a.o / 10.0, 6) + 0 AS v
    FROM total t JOIN deg ON deg.node_id = t.node_id JOIN f ON f.node_id = t.node_id AND f.j = t.j JOIN w1 a ON a.k = t.j JOIN w2 b ON b.k = t.j AND b.o = a.o GROUP BY t.node_id, a.o"""))
def sage_layer(spark, sf):
    return _signless(model.sage_layer(fx.edges(spark, sf), _feats(spark, sf), fx.nodes(spark, sf), weights(WIDTH, OUT, 2), weights(WIDTH, OUT, 1), bias(OUT)))


@query(with_graph(_LOOPED + _NORM.format(d="q", e="looped") + f""", w1 AS {_w(1)}, s AS (SELECT dst AS node_id, j, sum(v * w) AS v FROM qnorm JOIN f ON f.node_id = src GROUP BY ALL)
    SELECT node_id, o AS j, round(sum(v * w) + o / 10.0, 6) + 0 AS v FROM s JOIN w1 ON k = s.j GROUP BY node_id, o"""))
def gcn_layer(spark, sf):
    return _signless(model.gcn_layer(_norm(spark, sf, True), _feats(spark, sf), fx.nodes(spark, sf), weights(WIDTH, OUT, 1), bias(OUT)))


@query(with_graph(_CTE + """SELECT t.node_id, o AS j, round(sum((s + v) / (dg + 1) * w) + o / 10.0, 6) + 0 AS v
    FROM total t JOIN deg ON deg.node_id = t.node_id JOIN f ON f.node_id = t.node_id AND f.j = t.j JOIN w1 ON k = t.j GROUP BY t.node_id, o"""))
def sage_old_layer(spark, sf):
    return _signless(model.old_sage_layer(fx.edges(spark, sf), _feats(spark, sf), fx.nodes(spark, sf), weights(WIDTH, OUT, 1), bias(OUT)))


def _marked(spark, sf):
    return fx.nodes(spark, sf).where("node_id % 3 = 0").select("node_id", "label")


@query(with_graph(f", e AS {_w(4, WIDTH, 10)} SELECT f.node_id, j, round(v + coalesce(w, 0), 6) + 0 AS v FROM f JOIN nodes n ON n.node_id = f.node_id LEFT JOIN e ON e.o = j AND e.k = label AND f.node_id % 3 = 0"))
def mask_label_add(spark, sf):
    return _signless(d.label_rows(_feats(spark, sf), _marked(spark, sf), weights(10, WIDTH, 4)))


@query(with_graph(f", e AS {_w(4, 4, 10)} SELECT node_id, j, round(v, 6) + 0 AS v FROM f UNION ALL SELECT n.node_id, (64 + o)::INTEGER, CASE WHEN n.node_id % 3 = 0 THEN w ELSE 0 END + 0 FROM nodes n JOIN e ON e.k = label"))
def mask_label_concat(spark, sf):
    return _signless(d.label_rows(_feats(spark, sf), _marked(spark, sf), weights(10, 4, 4), True))


_HOP = f""", h AS (SELECT n.node_id, t.j::INTEGER AS j, coalesce(s, 0) AS v FROM nodes n CROSS JOIN range(64) t(j) LEFT JOIN (SELECT dst, f.j AS jj, sum(v) AS s FROM dense JOIN f ON f.node_id = src GROUP BY ALL) ON dst = n.node_id AND jj = t.j),
w1 AS {_w(1)}, w2 AS {_w(2)}, share AS (SELECT exp(0.2) / (exp(0.2) + exp(0.7)) AS a, exp(0.7) / (exp(0.2) + exp(0.7)) AS b),
x1 AS (SELECT node_id, o, sum(v * w) AS v FROM f JOIN w1 ON k = f.j GROUP BY ALL), x2 AS (SELECT node_id, o, sum(v * w) AS v FROM h JOIN w2 ON k = h.j GROUP BY ALL),
y1 AS (SELECT node_id, o, a * v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12) AS v FROM x1, share),
y2 AS (SELECT node_id, o, b * v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node_id)), 1e-12) AS v FROM x2, share)
"""


def _selected(spark, sf, how):
    x, nodes = _feats(spark, sf), fx.nodes(spark, sf)
    hop = agg.dense(nodes, agg.aggregate(fx.edges(spark, sf), x, WIDTH), WIDTH)
    return _signless(d.select_features([x, hop], [weights(WIDTH, OUT, 1), weights(WIDTH, OUT, 2)], np.array([0.2, 0.7]), how))


@query(with_graph(_HOP + "SELECT node_id, o AS j, round(greatest(v, 0), 6) + 0 AS v FROM y1 UNION ALL SELECT node_id, o + 8, round(greatest(v, 0), 6) + 0 FROM y2"))
def fs_concat(spark, sf):
    return _selected(spark, sf, "concat")


@query(with_graph(_HOP + "SELECT y1.node_id, y1.o AS j, round(greatest(y1.v + y2.v, 0), 6) + 0 AS v FROM y1 JOIN y2 ON y2.node_id = y1.node_id AND y2.o = y1.o"))
def fs_sum(spark, sf):
    return _selected(spark, sf, "sum")


def _judged(spark, sf):
    labels = fx.nodes(spark, sf).select("node_id", (F.col("label") % OUT).alias("label")).join(fx.split(spark, sf), "node_id")
    return model.accuracy(_logp(spark, sf), labels)


_JUDGED = _LOGP + ", lab AS (SELECT s.node_id, label % 8 AS label, split FROM nodes n JOIN split s ON s.node_id = n.node_id), best AS (SELECT node_id, arg_max(j, (v, -j)) AS j FROM logp GROUP BY node_id)"


@query(with_graph(_JUDGED + "SELECT split, round(sum(-v), 4) AS loss FROM lab JOIN logp ON logp.node_id = lab.node_id AND j = label GROUP BY split"))
def nll_sum(spark, sf):
    return _judged(spark, sf).select("split", F.round("loss", 4).alias("loss"))


@query(with_graph(_JUDGED + "SELECT split, round(avg(-v), 6) AS loss FROM lab JOIN logp ON logp.node_id = lab.node_id AND j = label GROUP BY split"))
def nll_mean(spark, sf):
    return _judged(spark, sf).select("split", F.round(F.col("loss") / F.col("total"), 6).alias("loss"))


@query(with_graph(_JUDGED + "SELECT split, count_if(j = label)::BIGINT AS correct, count(*)::BIGINT AS total FROM lab JOIN best ON best.node_id = lab.node_id GROUP BY split"))
def argmax_acc(spark, sf):
    return _judged(spark, sf).select("split", "correct", "total")


_U = "((node_id * 1103515245 + 12345) % 2147483648) / 2147483648.0"


@query(with_graph(f"SELECT node_id, split = 'train' AND {_U} < 0.62 AS propagated, split = 'train' AND NOT {_U} < 0.62 AS supervised FROM split"))
def supervision_mask(spark, sf):
    train = F.col("split") == "train"
    kept = sampling.thin(train, F.col("node_id"), 0.62)
    return fx.split(spark, sf).select("node_id", kept.alias("propagated"), sampling.supervision(train, kept).alias("supervised"))


@query(with_graph(f"SELECT node_id, CASE WHEN {_U} < 0.5 THEN 'a' WHEN {_U} < 0.75 THEN 'b' ELSE 'c' END AS pick FROM nodes"))
def multinomial(spark, sf):
    return fx.nodes(spark, sf).select("node_id", sampling.multinomial(F.col("node_id"), {"a": 2.0, "b": 1.0, "c": 1.0}).alias("pick"))


@query(with_graph(f"SELECT node_id FROM nodes ORDER BY {_U}, node_id LIMIT 50"))
def choice(spark, sf):
    """A sampling operator: its size is the feature."""
    return sampling.choose(fx.nodes(spark, sf).select("node_id"), "node_id", 50)


@query(with_graph(f", fl AS (SELECT dst AS node_id, sum(((src + 2 * dst) % 4 + 1)::DOUBLE / 4) AS flops FROM dense GROUP BY dst) SELECT node_id, flops FROM fl ORDER BY round(-ln(1 - {_U}) / flops, 12), node_id LIMIT 50"))
def choice_weighted(spark, sf):
    return sampling.choose_weighted(agg.flops(_weighted(spark, sf), "w"), "node_id", "flops", 50)


def _scattered(of: str, to: str) -> str:
    """Three steps of the draw of a column x, as expressions of CTEs."""
    step = "xor(x, x >> 16)"
    return f", {to}1 AS (SELECT * REPLACE ({step} * 73244475 % 2147483648 AS x) FROM {of}), {to}2 AS (SELECT * REPLACE ({step} * 73244475 % 2147483648 AS x) FROM {to}1), {to} AS (SELECT * REPLACE ({step} AS x) FROM {to}2)"


@query(with_graph(", ids AS (SELECT node_id, node_id AS x FROM nodes)" + _scattered("ids", "a") + ", cell AS (SELECT node_id, j::INTEGER AS j, s, x + j * 2 + s AS x FROM a, range(16) t(j), range(2) u(s)), bounded AS (SELECT * REPLACE (x % 2147483648 AS x) FROM cell)" + _scattered("bounded", "b") + ", u AS (SELECT node_id, j, max((x + 1) / 2147483648.0) FILTER (WHERE s = 0) AS p, max((x + 1) / 2147483648.0) FILTER (WHERE s = 1) AS q FROM b GROUP BY node_id, j) SELECT node_id, j, round((sqrt(-2 * ln(p)) * cos(2 * 3.141592653589793::DOUBLE * q))::FLOAT::DOUBLE, 5) + 0 AS v FROM u"))
def gaussian_features(spark, sf):
    rows = sampling.gaussian(fx.nodes(spark, sf), "node_id", 16)
    return cells(rows.select("node_id", F.transform("feat", lambda x: x.cast("double")).alias("feat")), 5).withColumn("v", F.col("v") + 0.0)


@query(with_graph("SELECT node_id, floor(before * 4 / total)::BIGINT AS worker FROM (SELECT node_id, coalesce(sum(k) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(k) OVER () AS total FROM (SELECT dst AS node_id, count(*) AS k FROM dense GROUP BY dst))"))
def work_rows(spark, sf):
    return sampling.split_rows(agg.flops(fx.edges(spark, sf)), 4)


@query(with_graph("SELECT part, p.node_id, ((row_number() OVER (PARTITION BY part ORDER BY p.node_id) - 1) // ((ceil(ceil(count(*) OVER (PARTITION BY part) / 3.0) / 4) * 4)::BIGINT))::BIGINT AS worker FROM part p"))
def work_blocks(spark, sf):
    from shardweave.plans.graph_queries import part_assign

    return sampling.rank_blocks(part_assign(spark, sf), "part", 4, 3)


# Gradients of one step, and training


def _labelled(spark, sf):
    """Nodes with one of eight labels and a split."""
    return fx.nodes(spark, sf).select("node_id", "feat", (F.col("label") % OUT).alias("label")).join(fx.split(spark, sf), "node_id")


_PULL = """, p AS (SELECT node_id, o, exp(z - max(z) OVER q) / sum(exp(z - m)) OVER q AS p FROM (SELECT *, max(z) OVER (PARTITION BY node_id) AS m FROM logit) WINDOW q AS (PARTITION BY node_id)),
lab AS (SELECT s.node_id, label % 8 AS label, split FROM nodes n JOIN split s ON s.node_id = n.node_id), seen AS (SELECT count(*) AS c FROM lab WHERE split = 'train'),
g AS (SELECT p.node_id, p.o, (p - CASE WHEN p.o = label THEN 1 ELSE 0 END) / seen.c AS g FROM p JOIN lab ON lab.node_id = p.node_id, seen WHERE split = 'train')
"""
_SAGE = _CTE + """, mean AS (SELECT t.node_id, t.j, s / greatest(dg, 1) AS v FROM total t JOIN deg ON deg.node_id = t.node_id),
logit AS (SELECT mean.node_id, a.o, sum(mean.v * b.w + f.v * a.w) + a.o / 10.0 AS z FROM mean JOIN f ON f.node_id = mean.node_id AND f.j = mean.j JOIN w1 a ON a.k = f.j JOIN w2 b ON b.k = f.j AND b.o = a.o GROUP BY mean.node_id, a.o)
""" + _PULL
_GCN = _LOOPED + _NORM.format(d="q", e="looped") + f""", w1 AS {_w(1)}, mean AS (SELECT dst AS node_id, j, sum(v * w) AS v FROM qnorm JOIN f ON f.node_id = src GROUP BY ALL),
logit AS (SELECT node_id, o, sum(v * w) + o / 10.0 AS z FROM mean JOIN w1 ON k = mean.j GROUP BY node_id, o)
""" + _PULL
_GRADIENT = "SELECT '{}' AS name, j::INTEGER AS i, o::INTEGER AS j, round(sum(v * g), 9) + 0 AS v FROM {} x JOIN g ON g.node_id = x.node_id GROUP BY x.j, g.o"
_BIAS = "SELECT 'bias' AS name, 0::INTEGER AS i, o::INTEGER AS j, round(sum(g), 9) + 0 AS v FROM g GROUP BY o"


def _one_layer(spark, sf, kind):
    spec = gnn.Spec(kind, (WIDTH, OUT))
    nodes = _labelled(spark, sf)
    params = {"near0": weights(WIDTH, OUT, 2 if kind == "sage" else 1), "own0": weights(WIDTH, OUT, 1), "bias0": bias(OUT)}
    if kind == "gcn":
        del params["own0"]
    return spec, params, gnn.over_edges(settle(gnn.weighted(kind, fx.edges(spark, sf), nodes), "weighted")), nodes


def _gradient(spark, sf, kind):
    """(name, i, j, v): the loss's gradient in every weight of one layer."""
    _, grads = gnn.loss_and_gradients(*_one_layer(spark, sf, kind))
    cells_ = [(k[:-1], i, j, round(float(v), 9) + 0.0) for k, g in grads.items() for i, row in enumerate(np.atleast_2d(g)) for j, v in enumerate(row)]
    return spark.createDataFrame(cells_, "name string, i int, j int, v double")


@query(with_graph(_SAGE + " UNION ALL ".join([_GRADIENT.format("near", "mean"), _GRADIENT.format("own", "f"), _BIAS])))
def sage_gradient(spark, sf):
    return _gradient(spark, sf, "sage")


@query(with_graph(_GCN + " UNION ALL ".join([_GRADIENT.format("near", "mean"), _BIAS])))
def gcn_gradient(spark, sf):
    return _gradient(spark, sf, "gcn")


@query(with_graph(_SAGE + """, own AS (SELECT g.node_id, k AS j, sum(g * w) AS v FROM g JOIN w1 ON w1.o = g.o GROUP BY ALL),
far AS (SELECT g.node_id, k AS j, sum(g * w) / greatest(any_value(dg), 1) AS v FROM g JOIN w2 ON w2.o = g.o JOIN deg ON deg.node_id = g.node_id GROUP BY ALL),
every AS (SELECT node_id, j, v FROM own UNION ALL SELECT src, j, v FROM dense JOIN far ON far.node_id = dst)
SELECT f.node_id, f.j, round(coalesce(sum(e.v), 0), 9) + 0 AS v FROM f LEFT JOIN every e ON e.node_id = f.node_id AND e.j = f.j GROUP BY f.node_id, f.j"""))
def sage_input_gradient(spark, sf):
    """The gradient that reaches the input rows, through the aggregation turned round."""
    rows = gnn.input_gradient(*_one_layer(spark, sf, "sage"))
    return cells(rows.select("node_id", F.col("g").alias("feat")), 9).withColumn("v", F.col("v") + 0.0)


def _history(spark, fit):
    return spark.createDataFrame([h[:-1] for h in fit.history], gnn.HISTORY.rsplit(", ", 1)[0])


def _trained(spark, sf, kind):
    nodes = settle(fx.nodes(spark, sf).select("node_id", "feat", "label").join(fx.split(spark, sf), "node_id"), "nodes")
    edges = settle(gnn.weighted(kind, fx.edges(spark, sf), nodes), "weighted")
    return _history(spark, gnn.fit(gnn.Spec(kind, (WIDTH, 16, 10), dropout=0.5, label_rate=0.62 if kind == "sage" else 0.0), gnn.over_edges(edges), nodes, epochs=2))


@query()
def train_sage(spark, sf):
    """Two layers with dropout, norm and shown labels; a row an epoch."""
    return _trained(spark, sf, "sage")


@query()
def train_gcn(spark, sf):
    return _trained(spark, sf, "gcn")


@query()
def train_fsgnn(spark, sf):
    """Train on rows propagated once with and without self loops; a row an epoch."""
    nodes = fx.nodes(spark, sf).select("node_id", "feat", "label").join(fx.split(spark, sf), "node_id")
    rows = gnn.hop_inputs(fx.edges(spark, sf), nodes, WIDTH, 1)
    return _history(spark, gnn.fit_hops(gnn.HopSpec(3, WIDTH, 16, 10, dropout=0.5), rows, epochs=3))
