"""Golden cases, invariances and round trips of the graph operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardweave.functions import codec, dense, quantise
from shardweave.operators import aggregate, cover, exchange, gnn, halo, model, normalise, partition, prep, sampling, telemetry
from shardweave.operators.components import components
from shardweave.operators.running import running
from shardweave.runtime import settle
from shardweave.sources import arrays, datasets, tables
from shardweave.streaming import logs


def edges(spark, src, dst, eids=None):
    rows = [(int(s), int(d), i) for i, (s, d) in enumerate(zip(src, dst, strict=True))] if eids is None else list(zip(src, dst, eids, strict=True))
    return spark.createDataFrame(rows, "src long, dst long, eid long")


def ids(spark, n, name="node_id"):
    return spark.range(n).withColumnRenamed("id", name)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


RAW = ([0, 0, 1, 2, 0, 3, 1], [1, 0, 2, 3, 1, 0, 2])


def test_edge_cleaning(spark):
    e = edges(spark, *RAW)
    assert got(prep.clean(e), "src", "dst", "eid") == [(0, 1, 0), (1, 2, 2), (2, 3, 3), (3, 0, 5)]
    assert got(prep.removed(e), "src", "dst", "eid", "reason") == [(0, 0, 1, "loop"), (0, 1, 4, "duplicate"), (1, 2, 6, "duplicate")]


def test_node_rows_on_raw_edges(spark):
    rows = prep.node_weights(ids(spark, 6), edges(spark, *RAW), spark.createDataFrame([(0,), (2,)], "node_id long"))
    assert got(rows, "node_id", "node_type", "w_in_degree", "w_train", "w_one") == [(0, 0, 2, 1, 1), (1, 0, 2, 0, 1), (2, 0, 2, 1, 1), (3, 0, 1, 0, 1), (4, 0, 0, 0, 1), (5, 0, 0, 0, 1)]
    nobody = prep.node_weights(ids(spark, 3), edges(spark, *RAW), spark.createDataFrame([], "node_id long"))
    assert got(nobody, "node_id", "w_train") == [(0, 1), (1, 0), (2, 0)]


def test_in_degrees(spark):
    dst = [0, 2, 0, 1, 2, 0, 1, 3, 4, 5]
    assert [d for _, d in got(prep.in_degree(ids(spark, 6), edges(spark, dst, dst)), "node_id", "deg")] == [3, 2, 2, 1, 1, 1]
    both = [0, 0, 1, 2, 3, 3]
    assert [d for _, d in got(prep.in_degree(ids(spark, 5), edges(spark, both, both), 1), "node_id", "deg")] == [2, 1, 1, 2, 1]
    assert got(prep.id_counts(spark.createDataFrame([(x,) for x in [1, 2, 3, 2, 1, 3, 3]], "a long"), "a"), "id", "n") == [(1, 2), (2, 2), (3, 3)]


@pytest.mark.parametrize(("dst", "begin", "end", "local", "remote"), [
    ([0, 1, 2, 3, 4], 0, 4, [(i, i) for i in range(5)], []),
    ([2, 3, 4, 5, 6], 2, 6, [(0, 2), (1, 3), (2, 4)], [(0, 0), (1, 1)]),
    ([5, 6, 7, 8, 9], 5, 10, [], [(i, i) for i in range(5)]),
])
def test_local_remote_split(spark, dst, begin, end, local, remote):
    s = partition.split_by_range(edges(spark, range(5), dst), begin, end)
    assert got(s.where("is_local"), "src", "dst") == local
    assert got(s.where("NOT is_local"), "src", "dst") == remote


def test_remap(spark):
    m = spark.createDataFrame([(0, 10, 10), (0, 11, 20), (0, 12, 30)], "part int, node_id long, orig_id long")
    at = lambda xs: sorted(r["local_id"] for r in partition.remap(spark.createDataFrame([(x,) for x in xs], "id long"), m).collect())
    assert at([20, 10, 30]) == [0, 1, 2] and at([40, 50]) == [] and at([]) == [] and at([20, 10, 20, 30, 10]) == [0, 0, 1, 1, 2]


def test_renumbering(spark):
    cut = spark.createDataFrame([(0, s, 0) for s in [2, 5, 5, 4, 4, 4, 1]], "dst_part long, src long, dst long").withColumn("src_part", F.lit(9).cast("long"))
    out = exchange.renumber(cut, spark.createDataFrame([(0, 2)], "part long, nodes long"))
    assert [x for (x,) in got(out, "remote_id")] == [2, 3, 4, 4, 4, 5, 5]
    blocks = [0, 0, 1, 1, 2, 2, 3, 3, 3, 4]
    rows = spark.createDataFrame(list(zip(blocks, [0, 0, 2, 2, 4, 5, 10, 11, 11, 12], strict=True)), "b long, id long")
    assert [x for (x,) in got(exchange.remap_ids(rows, "b", "id"), "new_id")] == [0, 0, 1, 1, 2, 3, 4, 5, 5, 6]


def pairs(spark, src, dst):
    return spark.createDataFrame([(0, 1, s, d) for s, d in zip(src, dst, strict=True)], "src_part long, dst_part long, src long, dst long")


@pytest.mark.parametrize(("src", "dst", "pre"), [
    ([1, 3, 1, 1], [2, 1, 2, 3], [0, 1, 0, 0]),
    ([2, 1, 2, 1, 0], [1, 4, 1, 1, 1], [1, 0, 1, 1, 1]),
    ([0, 2, 2, 2, 4, 4, 5, 5], [1, 1, 2, 4, 4, 3, 6, 3], [1, 0, 0, 0, 1, 1, 0, 1]),
    ([], [], []),
])
def test_degree_rule(spark, src, dst, pre):
    out = exchange.degree_modes(pairs(spark, src, dst))
    assert got(out, "src", "dst", "mode") == sorted(zip(src, dst, ["pre" if p else "post" for p in pre], strict=True))


def test_cover_rule(spark):
    out = exchange.cover_modes(pairs(spark, [2, 1, 2, 1, 0], [11, 14, 11, 11, 11]))
    assert got(out, "src", "dst", "mode") == [(0, 11, "pre"), (1, 11, "post"), (1, 14, "post"), (2, 11, "pre"), (2, 11, "pre")]
    assert sum(map(len, cover.vertex_cover([(1, 12), (3, 11), (1, 12), (1, 13)]))) == 2
    assert sum(map(len, cover.vertex_cover([(0, 11), (2, 11), (2, 12), (2, 14), (4, 14), (4, 13), (5, 16), (5, 13)]))) == 4


def test_cover_is_minimum_and_valid():
    rng = random.Random(3)
    for _ in range(300):
        e = [(rng.randrange(7), 100 + rng.randrange(7)) for _ in range(rng.randrange(1, 18))]
        left, right = cover.vertex_cover(e)
        assert all(u in left or v in right for u, v in e)
        us = sorted({u for u, _ in e})
        least = min(bin(m).count("1") + len({v for u, v in e if not m >> us.index(u) & 1}) for m in range(1 << len(us)))
        assert len(left) + len(right) == least
    chain = [(i, i) for i in range(3000)] + [(i + 1, i) for i in range(3000)]
    assert sum(map(len, cover.vertex_cover(chain))) == 3000


def test_large_pairs_are_split(spark):
    p = pairs(spark, [1, 1, 2, 7, 8, 8, 8], [11, 12, 12, 17, 17, 18, 19])
    whole, split = exchange.cover_modes(p), exchange.cover_modes(p, 4)
    assert exchange.messages(whole).count() == exchange.messages(split).count() == 4
    assert exchange.cover_modes(p, 1).where("mode IS NOT NULL").count() == 7  # every component over the bound that splits pairs: covered all the same


def test_no_component_is_left_out(spark):
    rng = random.Random(5)
    e = [(rng.randrange(30), 100 + rng.randrange(30)) for _ in range(90)]
    rows = cover.covers(pairs(spark, *map(list, zip(*e, strict=True))), 1).collect()
    left, right = ({r["node"] for r in rows if r["side"] == s} for s in ("src", "dst"))
    assert all(u in left or v in right for u, v in e)
    assert len(rows) == sum(map(len, cover.vertex_cover(e)))


def test_send_and_receive_lists(spark):
    p = pairs(spark, [0, 2, 2, 2, 4, 4, 5, 5], [1, 1, 2, 4, 4, 3, 6, 3]).withColumn("mode", F.when(F.expr("(src, dst) IN ((0L, 1L), (4L, 4L), (4L, 3L), (5L, 3L))"), "pre").otherwise("post"))
    assert [(s, d) for _, s, d in got(exchange.sent(p), "at", "src", "dst")] == [(0, 1), (2, 2), (4, 3), (5, 3), (4, 4), (5, 5)]
    r = pairs(spark, [1, 1, 2, 4, 4, 3, 6, 3], [0, 2, 2, 2, 4, 4, 5, 5]).withColumn("mode", F.when(F.expr("(src, dst) IN ((1L, 2L), (2L, 2L), (4L, 2L), (6L, 5L))"), "pre").otherwise("post"))
    assert [(s, d) for _, s, d in got(exchange.received(r), "at", "src", "dst")] == list(zip([1, 2, 3, 3, 4, 5], [0, 2, 4, 5, 4, 5], strict=True))


def random_graph(spark, n=40, m=300, width=5, seed=1):
    rng = np.random.default_rng(seed)
    e = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b})
    x = rng.integers(-8, 8, (n, width)).astype(float) / 4
    feats = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node_id long, feat array<double>")
    return spark.createDataFrame(e, "src long, dst long"), e, feats, x


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_plans_do_not_change_the_answer(spark, parts):
    df, e, feats, x = random_graph(spark)
    want = np.zeros_like(x)
    for a, b in e:
        want[b] += x[a]
    split = partition.split_edges(df, 40, parts)
    cut = exchange.cut_edges(split)
    plans = {"pre": exchange.constant_modes(cut, "pre"), "post": exchange.constant_modes(cut, "post"), "degree": exchange.degree_modes(cut), "cover": exchange.cover_modes(cut)}
    rows = {}
    for name, planned in plans.items():
        for r in exchange.aggregate_planned(split.where("is_local"), planned, feats, 5).collect():
            assert np.array_equal(want[r["node_id"]], r["feat"]), name
        rows[name] = exchange.messages(planned).count()
    assert rows["cover"] == min(rows.values())


@pytest.mark.parametrize("bits", [16, 4, 0])
def test_packed_exchange(spark, bits):
    """What crosses is the restored row, in both modes and both directions; nothing is packed outside training."""
    df, e, feats, x = random_graph(spark)
    split = partition.split_edges(df, 40, 3)
    planned = exchange.degree_modes(exchange.cut_edges(split).select("src", "dst", "src_part", "dst_part"))
    chosen = codec.choose_codec(bits or 32, shares={8: 0.3, 4: 0.3, 2: 0.4} if not bits else None)
    mode = {(r["src"], r["dst"]): r["mode"] for r in planned.collect()}
    drawn = {r["node_id"]: r["b"] for r in ids(spark, 40).select("node_id", quantise.assign_bits(F.col("node_id"), chosen.shares or chosen.bits).alias("b")).collect()}

    def sent(node, row):
        if bits == 16:
            return np.array([0.0 if v == 0 else np.rint(v / 2.0 ** (np.floor(np.log2(abs(v))) - 7)) * 2.0 ** (np.floor(np.log2(abs(v))) - 7) for v in row])
        spread = row.max() - row.min()
        scale = spread / (2 ** drawn[node] - 1) if spread else 1.0
        return np.rint((row - row.min()) / scale) * scale + row.min()

    part = lambda n: n // 14
    for back in (False, True):
        want, sums = np.zeros_like(x), {}
        for s, t in e:
            a, b = (t, s) if back else (s, t)
            if part(s) == part(t):
                want[b] += x[a]
            elif (mode[s, t] == "pre") != back:
                sums[part(a), b] = sums.get((part(a), b), 0) + x[a]
            else:
                want[b] += sent(a, x[a])
        for (_, b), row in sums.items():
            want[b] += sent(b, row)
        local = split.where("is_local")
        turned = local.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else local
        for r in exchange.aggregate_planned(turned, exchange.reversed_plan(planned) if back else planned, feats, 5, codec=chosen).collect():
            assert np.allclose(want[r["node_id"]], r["feat"], atol=1e-9), (bits, back)
    assert codec.choose_codec(bits or 32, training=False) is codec.PLAIN


def test_half_floats(spark):
    x = np.random.default_rng(8).normal(size=500) * 10.0 ** np.random.default_rng(9).integers(-44, 38, 500)
    x = np.concatenate([x.astype(np.float32), np.array([0, 1, -1, 255.5, 256.5, np.inf, -np.inf, 1e-40, 2.0**-126, 2.0**-133], np.float32)])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", codec.half_code(F.col("v")).alias("c")).withColumn("back", codec.half_value(F.col("c")))
    raw = x.view(np.uint32).astype(np.uint64)
    for r in rows.collect():
        want = int((raw[r["i"]] + 0x7FFF + (raw[r["i"]] >> np.uint64(16) & np.uint64(1))) >> np.uint64(16))
        if abs(x[r["i"]]) >= 2.0**-126 or x[r["i"]] == 0:  # below, values are rounded twice
            assert r["c"] == want, x[r["i"]]
            assert np.float32(r["back"]).view(np.uint32) >> 16 == want


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), int(w)) for g in range(3) for i, w in zip(rng.permutation(90)[:50] * (10**15 if g == 2 else 1), rng.integers(0, 9, 50), strict=True)]
    df = spark.createDataFrame(rows, "g int, i long, w long")
    for ranges in (1, 7, 1024):
        out = running(df, ["g"], ["i"], F.col("w"), ranges=ranges).collect()
        assert len(out) == 150 and all(r["before"] == sum(w for g, i, w in rows if g == r["g"] and i < r["i"]) for r in out)
    assert sorted(r["k"] for r in running(ids(spark, 9), [], ["node_id"], name="k").collect()) == list(range(9))
    assert running(ids(spark, 0), [], ["node_id"]).count() == 0


def test_add_sums_any_number_of_rows(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [5.0])], "node_id long, feat array<double>")
    more = spark.createDataFrame([(0, [10.0]), (0, [100.0]), (0, [1000.0]), (2, [7.0])], "node_id long, feat array<double>")
    assert got(aggregate.add(one, more, 1), "node_id", "feat") == [(0, [1111.0]), (1, [5.0]), (2, [7.0])]


def test_owner_by_ranges(spark):
    bounds = spark.createDataFrame([(0, 0, 3), (1, 3, 3), (2, 3, 1000), (3, 1000, 1001)], "part long, begin long, end long")
    nodes = spark.createDataFrame([(x, "a") for x in (0, 2, 3, 500, 999, 1000, 1001, -1)], "node long, extra string")
    for buckets in (1, 5, 4096):
        assert got(partition.owner(nodes, "node", bounds, "p", buckets), "node", "p", "extra") == [(0, 0, "a"), (2, 0, "a"), (3, 2, "a"), (500, 2, "a"), (999, 2, "a"), (1000, 3, "a")]


def test_reductions_and_transpose(spark):
    df, e, feats, x = random_graph(spark)
    for how, f in (("sum", np.sum), ("mean", np.mean), ("min", np.min), ("max", np.max), ("mul", np.prod)):
        for r in aggregate.aggregate(df, feats, 5, how).collect():
            assert np.allclose(r["feat"], f(x[[a for a, b in e if b == r["node_id"]]], axis=0))
    y = np.random.default_rng(2).normal(size=x.shape)
    ax = {r["node_id"]: np.array(r["feat"]) for r in aggregate.aggregate(df, feats, 5).collect()}
    other = spark.createDataFrame([(i, y[i].tolist()) for i in range(40)], "node_id long, feat array<double>")
    aty = {r["node_id"]: np.array(r["feat"]) for r in aggregate.aggregate(df, other, 5, by="src").collect()}
    assert np.isclose(sum(v @ y[k] for k, v in ax.items()), sum(v @ x[k] for k, v in aty.items()))
    wide = aggregate.WIDE
    aggregate.WIDE = 2
    try:
        for r in aggregate.aggregate(df, feats, 5).collect():
            assert np.array_equal(r["feat"], ax[r["node_id"]])
    finally:
        aggregate.WIDE = wide


def test_isolated_nodes_and_zero_degrees(spark):
    e, nodes = edges(spark, [0], [1]), ids(spark, 3)
    feats = nodes.select("node_id", F.array(F.lit(2.0)).alias("feat"))
    assert got(aggregate.dense(nodes, aggregate.aggregate(e, feats, 1), 1), "node_id", "feat") == [(0, [0.0]), (1, [2.0]), (2, [0.0])]
    assert got(normalise.symmetric(e, nodes), "src", "dst", "w") == [(0, 1, 0.0)]
    assert got(aggregate.aggregate(e, feats.select("node_id", F.array(F.lit(0.0)).alias("feat")), 1, "div"), "feat") == [([None],)]


def test_mixed_bit_packing(spark):
    rows = [(0, [0.2, 0.1, 0.3], 8), (1, [0.4, 0.5, 0.6], 4), (2, [0.7, 0.8, 0.9], 2), (3, [1.0, 1.1, 1.2], 4), (4, [0.3, 0.1, 0.7], 4)]
    df = spark.createDataFrame(rows, "node_id long, feat array<float>, b int")
    q = quantise.quantise(df, F.col("b")).withColumn("packed", quantise.pack_big(F.col("code"), F.col("num_bits"), 3))
    assert [b for r in sorted(q.collect()) for b in r["packed"]] == [127, 0, 255, 7, 240, 44, 8, 240, 80, 240]
    back = q.select("node_id", "feat", "par", quantise.restore(quantise.unpack_big(F.col("packed"), F.col("num_bits"), 3), F.col("par")).alias("v"))
    for r in back.collect():
        assert np.all(np.abs(np.array(r["feat"]) - r["v"]) <= r["par"]["scale"] / 2 + 1e-9)


def test_packed_ranges(spark):
    for width, bits, want in ((4, [8, 4, 2, 8, 4, 2], [0, 4, 6, 7, 11, 13, 14]), (1, [2, 2, 2], [0, 1, 2, 3]), (3, [4, 4, 2], [0, 2, 4, 5])):
        df = spark.createDataFrame([(0, i, b) for i, b in enumerate(bits)], "g int, i int, num_bits int")
        assert [0, *(e for _, e in got(exchange.byte_ranges(df, width, "g", "i"), "begin", "end"))] == want
    flat = spark.createDataFrame([(0, [3.0, 3.0])], "node_id long, feat array<float>")
    assert quantise.quantise(flat, F.lit(2)).first()["code"] == [0, 0]


def test_dense_rows(spark):
    rng = np.random.default_rng(4)
    x, w, b = rng.normal(size=(7, 30)), rng.normal(size=(30, 200)), rng.normal(size=200)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "node_id long, feat array<double>")
    for cols in (5, 200):  # literals; Arrow batches
        for r in dense.linear(df, w[:, :cols], b[:cols]).collect():
            assert np.allclose(r["feat"], x[r["node_id"]] @ w[:, :cols] + b[:cols])
    big = spark.createDataFrame([(0, [1000.0, 1001.0])], "node_id long, feat array<double>")
    assert np.allclose(big.select(dense.softmax_log(F.col("feat"))).first()[0], [-1.3132617, -0.3132617])
    assert big.select(dense.argmax(F.array(F.lit(2.0), F.lit(2.0)))).first()[0] == 0


def slopes(loss, params):
    """Central differences of ``loss`` in two cells of every parameter."""
    rng = np.random.default_rng(11)
    for name, p in params.items():
        for at in rng.choice(p.size, min(2, p.size), replace=False):
            up, down = ({**params, name: p.copy()} for _ in range(2))
            up[name].flat[at] += 1e-5
            down[name].flat[at] -= 1e-5
            yield name, at, (loss(up) - loss(down)) / 2e-5


def graph_nodes(spark, x, classes=3):
    rows = [(i, x[i].tolist(), i % classes, ("train", "train", "valid", "test")[i % 4]) for i in range(len(x))]
    return spark.createDataFrame(rows, "node_id long, feat array<double>, label long, split string")


def by_hand(spec, params, a, x, labels, split, epoch):
    """The training loss by dense matrices."""
    draw = ((np.arange(len(x)) + epoch) * 1103515245 + 12345) % 2**31 / 2**31
    shown = (split == "train") & (draw < spec.label_rate)
    h = x.copy()
    if spec.label_rate:
        emb = np.where(shown[:, None], params["labels"][labels], 0)
        h = np.concatenate([x, emb], axis=1) if spec.label_width else x + emb
    for i in range(spec.layers):
        h, _ = gnn.layer(spec, params, i, np.arange(len(x)), h, a @ h, epoch)
    learnt = (split == "train") & ~shown
    return -gnn.log_softmax(h)[learnt, labels[learnt]].sum() / ((split == "train").sum() * (1 - spec.label_rate))


@pytest.mark.parametrize("spec", [
    gnn.Spec("sage", (5, 4, 3), True, 0.3, 0.4), gnn.Spec("gcn", (5, 4, 3), True), gnn.Spec("sage", (5, 4, 3), False, 0.0, 0.4, 2),
])
def test_gradients_through_the_aggregation(spark, spec):
    df, e, _, x = random_graph(spark)
    nodes = graph_nodes(spark, x)
    split, labels = np.array([("train", "train", "valid", "test")[i % 4] for i in range(40)]), np.arange(40) % 3
    weights = settle(gnn.weighted(spec.kind, df, nodes), "w")
    a = np.zeros((40, 40))
    for r in weights.collect():
        a[r["dst"], r["src"]] = r["w"]
    params = gnn.init(spec, 3)
    rng = np.random.default_rng(4)
    params = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in params.items()}
    loss, grads = gnn.loss_and_gradients(spec, params, gnn.over_edges(weights), nodes, epoch=1)
    hand = lambda p: by_hand(spec, p, a, x, labels, split, 1)
    assert np.isclose(loss, hand(params))
    for name, at, slope in slopes(hand, params):
        assert np.isclose(grads[name].flat[at], slope, rtol=1e-4, atol=1e-7), (name, at)


@pytest.mark.parametrize("how", ["concat", "sum"])
def test_gradients_of_hop_models(spark, how):
    df, _, _, x = random_graph(spark)
    rows = gnn.hop_inputs(df, graph_nodes(spark, x), 5, 1)
    spec = gnn.HopSpec(3, 5, 4, 3, how, True, 0.3)
    params = {k: v + 0.1 * np.random.default_rng(5).normal(size=v.shape) for k, v in gnn.init_hops(spec).items()}
    held = rows.where("split = 'train'").orderBy("node_id").collect()
    node, xs, y = np.array([r["node_id"] for r in held]), [np.array([r[f"x{i}"] for r in held]) for i in range(3)], [r["label"] for r in held]
    hand = lambda p: -gnn.hops_forward(spec, p, node, xs, 2)[0][np.arange(len(y)), y].mean()
    loss, grads = gnn.hops_gradients(spec, params, rows, 2)
    assert np.isclose(loss, hand(params))
    for name, at, slope in slopes(hand, params):
        assert np.isclose(grads[name].flat[at], slope, rtol=1e-4, atol=1e-7), (name, at)
    fit = gnn.fit_hops(spec, rows, 8, rate=0.1)
    assert fit.history[-1][1] < fit.history[0][1]


def test_training_keeps_the_best(spark, tmp_path):
    df, _, _, x = random_graph(spark)
    nodes = graph_nodes(spark, x + 3 * np.eye(3, 5)[np.arange(40) % 3])
    spec = gnn.Spec("sage", (5, 3), False)
    sums = gnn.over_edges(settle(gnn.weighted("sage", df, nodes), "w"))
    fit = gnn.fit(spec, sums, nodes, 4, rate=0.3, checkpoint=str(tmp_path / "best"))
    assert fit.history[-1][1] < fit.history[0][1]
    assert fit.best_epoch == int(np.argmin([h[2] for h in fit.history])) and fit.best_test == max(h[5] for h in fit.history)
    kept = model.load_weights(spark, str(tmp_path / "best"))
    assert all(np.array_equal(kept[k][0].reshape(v.shape), v) for k, v in fit.params.items())
    assert fit.final["test"] == fit.history[fit.best_epoch][5]


def test_weights_round_trip(spark, tmp_path):
    ws = {"conv0": [np.arange(6.0).reshape(2, 3), np.ones((1, 3))]}
    model.save_weights(spark, str(tmp_path / "w"), ws)
    back = model.load_weights(spark, str(tmp_path / "w"))
    assert all(np.array_equal(a, b) for a, b in zip(ws["conv0"], back["conv0"], strict=True))


def test_stacked_layers(spark):
    df, _, feats, _ = random_graph(spark)
    rng = np.random.default_rng(6)
    stack = [(rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), np.zeros(4)), (rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), np.zeros(3))]
    out = model.predict(lambda rows, *w: model.sage_layer(df, rows, feats, *w), feats, stack).collect()
    assert len(out) == 40 and all(np.isclose(np.exp(r["feat"]).sum(), 1) for r in out)


def test_components(spark):
    n = 60
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "src long, dst long")
    out = dict(got(components(path), "node", "component"))
    assert out == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% x\n3 3 2\n1 2 0.5\n3 1 2\n")
    assert got(tables.read_matrix_market(spark, str(tmp_path / "m.mtx")), "src", "dst", "w") == [(0, 1, 0.5), (2, 0, 2.0)]
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    assert got(arrays.read_npy(spark, str(tmp_path / "a.npy")), "row", "value") == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    np.arange(6, dtype="<f4").tofile(tmp_path / "raw.bin")
    assert got(arrays.read_raw_floats(spark, str(tmp_path / "raw.bin"), 3), "row", "feat") == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    (tmp_path / "p000-g_nodes.txt").write_text("0 1 1 1 1 7\n1 1 1 1 1 5\n")
    assert got(tables.read_partitioner_nodes(spark, str(tmp_path / "p*-g_nodes.txt")), "part", "node_id", "orig_id") == [(0, 0, 7), (0, 1, 5)]
    nodes = tables.synthetic_nodes(spark, 20, 3, 10, 4, 2, 5).withColumn("part", partition.part_of(F.col("node_id"), 20, 2))
    tables.write_parts(nodes, str(tmp_path / "g/nodes"))
    tables.write_parts(edges(spark, [1, 2], [3, 15]).withColumn("part", partition.part_of(F.col("dst"), 20, 2)), str(tmp_path / "g/edges"))
    part = datasets.load("part", spark, str(tmp_path / "g"), 1)
    assert part.nodes.count() == 10 and got(part.edges, "src", "dst") == [(2, 15)]
    tables.write_bounds(partition.bounds(nodes), str(tmp_path / "b"))
    assert tables.read_bounds(spark, str(tmp_path / "b")) == [0, 10, 20]
    tables.write_stats(prep.graph_stats(nodes, edges(spark, [1], [2]), 0), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()["value"] == "20 1 0 "
    tables.write_graph(tables.Graph(None, edges(spark, [1, 2], [3, 4]).withColumn("rel", F.lit("cites"))), str(tmp_path / "h"))
    assert datasets.load("relation", spark, str(tmp_path / "h"), "cites").edges.count() == 2
    assert got(tables.shift_relation(spark.read.parquet(str(tmp_path / "h/edges")), "cites", 0, 100), "src", "dst") == [(1, 103), (2, 104)]
    with pytest.raises(ValueError):
        datasets.load("nothing")
    made = []
    for _ in range(2):
        tables.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
    assert made == [1]


def test_matrix_market(spark, tmp_path):
    at = tmp_path / "m.mtx"
    read = lambda text: at.write_text(text) and got(tables.read_matrix_market(spark, str(at)), "src", "dst", "w")
    assert read("%%MatrixMarket matrix coordinate real general\n% c\n3 3 2\n3 3 2\n1 2 0.5\n") == [(0, 1, 0.5), (2, 2, 2.0)]  # an edge that reads as the size line
    assert read("%%MatrixMarket matrix coordinate integer general\n3 3 3\n3 3 3\n3 3 3\n1 2 4\n") == [(0, 1, 4.0), (2, 2, 3.0), (2, 2, 3.0)]
    assert read("%%MatrixMarket matrix coordinate pattern symmetric\n\n3 3 2\n2 1\n3 3\n") == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    assert read("%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 1\n2 1 5\n") == [(0, 1, -5.0), (1, 0, 5.0)]


def test_arrays_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "CHUNK", 64)
    x = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    for name, a in (("c", x), ("f", np.asfortranarray(x))):
        np.save(tmp_path / f"{name}.npy", a)
        rows = sorted((r["row"], r["value"]) for r in arrays.read_npy(spark, str(tmp_path / f"{name}.npy")).collect())
        assert np.array_equal([v for _, v in rows], x.astype(float)) and [i for i, _ in rows] == list(range(50))
    e = np.random.default_rng(2).integers(0, 2**40, (30, 2))
    for name, a in (("rows", e), ("cols", np.ascontiguousarray(e.T)), ("turned", np.asfortranarray(e.T))):
        np.save(tmp_path / f"{name}.npy", a)
        assert got(arrays.read_npy_edges(spark, str(tmp_path / f"{name}.npy")), "eid", "src", "dst") == [(i, *map(int, r)) for i, r in enumerate(e)]
    np.save(tmp_path / "none.npy", np.zeros(0, np.int64))
    assert arrays.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    feats = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "node_id long, feat array<float>")
    assert arrays.write_npy(feats, str(tmp_path / "out"), "feat", "node_id", parts=4) == 50
    parts = sorted((tmp_path / "out").glob("*.npy"))
    assert len(parts) > 1 and np.array_equal(np.concatenate([np.load(f) for f in parts]), x)
    assert arrays.read_npy(spark, str(tmp_path / "out")).count() == 50


def test_named_sets(spark, tmp_path):
    rng = np.random.default_rng(3)
    e, x, y = rng.integers(0, 20, (40, 2)), rng.normal(size=(20, 4)), np.where(np.arange(20) % 3, np.arange(20) % 5, np.nan)

    def save(name, a):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        np.save(tmp_path / name, a)

    save("m/paper/node_feat.npy", x.astype(np.float16))
    save("m/paper/node_label.npy", y)
    save("m/paper___cites___paper/edge_index.npy", e.T)
    save("m/author___affiliated_with___institution/edge_index.npy", e.T)
    for i, s in enumerate(("train", "valid", "test-dev")):
        save(f"m/split/{s}.npy", np.arange(i, 20, 4))
    g = datasets.load("mag240M", spark, str(tmp_path / "m"))
    assert got(g.edges, "eid", "src", "dst") == [(i, *map(int, r)) for i, r in enumerate(e)]
    assert [(i, l, s) for i, l, s in sorted((r["node_id"], r["label"], r["split"]) for r in g.nodes.collect())] == [(i, int(y[i]) if i % 3 else -1, ("train", "valid", "test", None)[i % 4]) for i in range(20)]
    assert got(datasets.load("mag240M-affiliations", spark, str(tmp_path / "m"), 100).edges, "eid", "dst") == [(i, int(r[1]) + 100) for i, r in enumerate(e)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/proteins.mtx").write_text("%%MatrixMarket matrix coordinate real general\n9 9 1\n1 2 0.5\n")
    g = datasets.load("proteins", spark, str(tmp_path / "p"), n=9, width=2, train=4, test=2, valid=1, classes=3)
    assert g.nodes.count() == 9 and got(g.edges, "src", "dst") == [(0, 1)]
    (tmp_path / "i/processed/paper").mkdir(parents=True)
    x.astype("<f4").tofile(tmp_path / "i/processed/paper/node_feat.npy")
    np.arange(20, dtype="<f4").tofile(tmp_path / "i/processed/paper/node_label_19.npy")
    save("i/processed/paper__cites__paper/edge_index.npy", e)
    g = datasets.load("IGB260M", spark, str(tmp_path / "i"), n=20, labelled=10, width=4)
    assert got(g.nodes, "node_id", "label", "split")[5:12] == [(5, 5, "train"), (6, 6, "valid"), (7, 7, "valid"), (8, 8, "test"), (9, 9, "test"), (10, 10, None), (11, 11, None)]
    assert got(g.edges, "eid", "src") == [(i, int(r[0])) for i, r in enumerate(e)]
    marks = spark.createDataFrame([(i, [1.0], float(i), i < 3, i == 3, i > 3) for i in range(6)], "node_id long, feat array<double>, label double, train_mask boolean, val_mask boolean, test_mask boolean")
    tables.write_graph(tables.Graph(marks, spark.createDataFrame([(i, 5 - i) for i in range(6)], "src long, dst long").coalesce(1)), str(tmp_path / "r"))
    g = datasets.load("reddit", spark, str(tmp_path / "r"))
    assert [s for _, s in got(g.nodes, "node_id", "split")] == ["train"] * 3 + ["valid", "test", "test"]
    assert got(g.edges, "eid", "src") == [(i, i) for i in range(6)]
    assert got(tables.masks_to_ids(marks, "val_mask"), "node_id") == [(3,)]
    for s in ("train", "valid", "test"):
        arrays.write_npy(g.nodes.where(F.col("split") == s), str(tmp_path / f"g_nodes_{s}_idx.npy"), "node_id", "node_id", "<i8")
    assert got(datasets.read_index_lists(spark, str(tmp_path), "g"), "node_id", "split") == got(g.nodes, "node_id", "split")


@pytest.mark.parametrize(("delay", "bits"), [(False, 32), (True, 32), (True, 8)])
def test_a_run_from_its_folder(spark, tmp_path, delay, bits):
    df, e, _, x = random_graph(spark)
    nodes = graph_nodes(spark, x).withColumn("part", partition.part_of(F.col("node_id"), 40, 3))
    tables.write_parts(nodes, str(tmp_path / "nodes"))
    tables.write_parts(df.withColumn("part", partition.part_of(F.col("dst"), 40, 3)), str(tmp_path / "edges"))
    tables.write_bounds(partition.bounds(nodes), str(tmp_path / "bounds"))
    text = f"input_dir: {tmp_path}\nmodel_name: sage\nin_channels: 5\nhidden_channels: 4\nout_channels: 3\nnum_layers: 2\nnum_bits: {bits}\nis_pre_delay: {delay}\nnum_epochs: 1\n"
    run = halo.load(spark, tables.Settings.read(text))
    feats = run.nodes.select("node_id", "feat")
    whole = {r["node_id"]: r["feat"] for r in run.halo.whole(feats, 5).collect()}
    planned = {r["node_id"]: r["feat"] for r in run.halo.sums().forward(feats, 5, bits != 8).collect()}
    assert whole.keys() == planned.keys() and all(np.allclose(whole[k], planned[k]) for k in whole)
    assert run.halo.planned.where("mode = 'pre'").isEmpty() != delay
    assert got(run.halo.degrees, "node_id", "deg") == [(i, sum(b == i for _, b in e)) for i in range(40)]
    if bits == 8:  # training packs what crosses: near the plain answer, not equal
        packed = {r["node_id"]: r["feat"] for r in run.halo.sums().forward(feats, 5, True).collect()}
        apart = max(np.abs(np.array(whole[k]) - packed[k]).max() for k in whole)
        assert 0 < apart < 0.1
        fit = run.train(str(tmp_path / "best"))
        assert len(fit.history) == 1 and 0 <= fit.final["test"] <= 1


def test_settings():
    s = tables.Settings.read("graph_name: 'products'  # x\nnum_bits: 2\nis_pre_delay: true\nlr: 0.1\n", num_epochs=7, lr=None)
    assert (s.graph_name, s.num_bits, s.is_pre_delay, s.lr, s.num_epochs) == ("products", 2, True, 0.1, 7)
    with pytest.raises(ValueError):
        tables.Settings.read("nobody: 1")
    assert tables.input_dir("/d/", "products", 4, True) == "/d/ogbn_products_4_part/"


LINE = "Rank: 0, Epoch: {}, Train loss: 0.4007, Val loss: 1.5, Train: 0.9194, Val: 0.9094, Test: 0.7783, Time: {}\n"


def test_logs(spark, tmp_path):
    for name, seconds in (("32bit", "1.5"), ("2bit", "0.5")):
        at = tmp_path / "runs" / "4proc" / name
        at.mkdir(parents=True)
        (at / "stdout.1.0").write_text("noise 1\n" + "".join(LINE.format(i, "9.0" if i == 0 else seconds) for i in range(3)) + "Epoch: 1 2\n")
    records = telemetry.parse_log(tables.read_logs(spark, str(tmp_path / "runs")))
    assert records.count() == 6
    assert got(telemetry.epoch_time(records), "world_size", "variant", "seconds") == [(4, "2bit", 0.5), (4, "32bit", 1.5)]
    assert [n for (n,) in got(records.where("variant = '2bit'"), "line_no")] == [1, 2, 3]
    logs.watch(spark, str(tmp_path / "runs"), str(tmp_path / "out"), str(tmp_path / "ck"))
    logs.watch(spark, str(tmp_path / "runs"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got(logs.summary(spark, str(tmp_path / "out")), "variant", "seconds") == [("2bit", 0.5), ("32bit", 1.5)]
    older = spark.createDataFrame([("p", 1, "v", 0, "Rank 0, World 32, Epoch: 144, 0.4, 0.91, 0.90, 0.77, 1.88")], "path string, world_size int, variant string, line_no long, line string")
    r = telemetry.parse_log(older, True).first()
    assert (r["world_size"], r["epoch"], r["loss"], r["test_acc"], r["seconds"]) == (32, 144, 0.4, 0.77, 1.88)


def test_recorder(spark):
    rec = telemetry.Recorder()
    for _ in range(2):
        with rec.block("a"):
            pass
    rec.mode = "eval"
    with rec.block("a"):
        pass
    assert got(telemetry.summary(rec.table(spark)), "module", "epoch", "n") == [("a", 0, 2)]


def test_sampling(spark):
    n = ids(spark, 4000)
    share = n.where(sampling.thin(F.lit(True), F.pmod(F.xxhash64("node_id"), F.lit(100000)), 0.62)).count() / 4000
    assert 0.55 < share < 0.69
    assert sampling.choose(n, "node_id", 10).distinct().count() == 10
    assert sampling.split_even(10, 3) == [(0, 4), (4, 8), (8, 10)] and sampling.split_even(10, 4, 4) == [(0, 4), (4, 8), (8, 10), (10, 10)]
    stats = sampling.gaussian(n, "node_id", 1).select(F.avg(F.col("feat")[0]).alias("m"), F.stddev(F.col("feat")[0]).alias("s")).first()
    assert abs(stats["m"]) < 0.1 and abs(stats["s"] - 1) < 0.1


def test_normalised_parts_equal_the_whole(spark):
    df, _, _, _ = random_graph(spark)
    nodes = ids(spark, 40)
    whole = got(normalise.symmetric(df, nodes), "src", "dst", "w")
    split = partition.split_edges(df, 40, 4)
    parts = normalise.symmetric(split.where("is_local").unionByName(split.where("NOT is_local")), nodes)
    assert got(parts, "src", "dst", "w") == whole
