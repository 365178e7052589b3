"""Exchange planning (J1-J12, G1-G7, H1, H2): which rows cross part boundaries, aggregated before or after.

A plan is a column: ``mode`` of a cut edge is 'pre' (its source's part sums for
the destination first and sends the sum) or 'post' (the source row is sent once
to the destination's part and summed there). The answer never depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardweave.functions.codec import PLAIN, Codec, decode, encode
from shardweave.operators.aggregate import aggregate, reduced
from shardweave.operators.cover import covers
from shardweave.operators.running import running
from shardweave.runtime import settle

PAIR = ["src_part", "dst_part"]


def cut_edges(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_local"))


def demand(cut: DataFrame) -> DataFrame:
    """(src_part, dst_part, src): rows each part needs of each owner (J1); one query gives both sides."""
    return cut.select(*PAIR, "src").distinct()


def degree_modes(cut: DataFrame) -> DataFrame:
    """Mode by the degree rule (J2, E7): post where the source has more edges into the part than the destination has from it.

    Degrees are counted with partial aggregates and joined, so a hub's edges can be split over tasks.
    """
    out = cut.groupBy(*PAIR, "src").agg(F.count(F.lit(1)).alias("__out"))
    into = cut.groupBy(*PAIR, "dst").agg(F.count(F.lit(1)).alias("__into"))
    ruled = cut.join(out, [*PAIR, "src"]).join(into, [*PAIR, "dst"])
    return ruled.select(*cut.columns, F.when(F.col("__out") > F.col("__into"), "post").otherwise("pre").alias("mode"))


def cover_modes(cut: DataFrame, max_edges: int = 200_000) -> DataFrame:
    """Mode by a minimum vertex cover of each part pair (J3, E6): post where the source is covered, the least rows sent."""
    cover = settle(covers(cut, max_edges), "cover")
    left = cover.where("side = 'src'").select(*PAIR, F.col("node").alias("src"), F.lit(True).alias("__l"))
    right = cover.where("side = 'dst'").select(*PAIR, F.col("node").alias("dst"), F.lit(True).alias("__r"))
    ruled = cut.join(left, [*PAIR, "src"], "left").join(right, [*PAIR, "dst"], "left")
    mode = F.when(F.col("__l").isNotNull(), "post").when(F.col("__r").isNotNull(), "pre")  # every edge has a covered end
    return ruled.select(*cut.columns, mode.alias("mode"))


def constant_modes(cut: DataFrame, mode: str) -> DataFrame:
    return cut.withColumn("mode", F.lit(mode))


def sent(planned: DataFrame) -> DataFrame:
    """Edges on the sending side (J4, D-5): those of pre as they are, and (src, src) once for each source of post.

    ``at`` is a row's place in its part pair's list, which is in order of dst (H2).
    """
    pre = planned.where("mode = 'pre'").select(*PAIR, "src", "dst")
    rows = pre.unionByName(planned.where("mode = 'post'").select(*PAIR, "src", F.col("src").alias("dst")).distinct())
    return running(rows, PAIR, ["dst", "src"], name="at")


def received(planned: DataFrame) -> DataFrame:
    """Edges on the receiving side (J5, D-6): those of post as they are, and (dst, dst) once for each destination of pre; ``at`` in order of src (H2)."""
    post = planned.where("mode = 'post'").select(*PAIR, "src", "dst")
    rows = post.unionByName(planned.where("mode = 'pre'").select(*PAIR, F.col("dst").alias("src"), "dst").distinct())
    return running(rows, PAIR, ["src", "dst"], name="at")


def messages(planned: DataFrame) -> DataFrame:
    """(src_part, dst_part, mode, node): a row for each feature row that crosses."""
    return planned.select(*PAIR, "mode", F.when(F.col("mode") == "pre", F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()


def volumes(planned: DataFrame, parts: int) -> DataFrame:
    """(src_part, dst_part, n_rows, packed_8, packed_4, packed_2) of every pair, zeros too (J12, F21): packed rows are ceil(n * bits / 8)."""
    spark = planned.sparkSession
    every = spark.range(parts).select(F.col("id").alias("src_part")).crossJoin(spark.range(parts).select(F.col("id").alias("dst_part")))  # a row a part pair
    n = messages(planned).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_rows"))
    out = every.join(n, PAIR, "left").fillna(0, ["n_rows"])
    return out.withColumns({f"packed_{b}": F.ceil(F.col("n_rows") * b / 8).cast("long") for b in (8, 4, 2)})


def part_volumes(volume: DataFrame) -> DataFrame:
    """(part, sent, received): rows each part sends and gets."""
    s = volume.groupBy(F.col("src_part").alias("part")).agg(F.sum("n_rows").alias("sent"))
    return s.join(volume.groupBy(F.col("dst_part").alias("part")).agg(F.sum("n_rows").alias("received")), "part")


def renumber(cut: DataFrame, local: DataFrame) -> DataFrame:
    """(dst_part, src, dst, remote_id): sources of a part's cut edges numbered in order after its own nodes (G1, H1).

    ``local`` has (part, nodes). Numbers are made over distinct sources.
    """
    needed = cut.select("dst_part", "src").distinct()
    numbered = running(needed, ["dst_part"], ["src"], name="r").join(local.select(F.col("part").alias("dst_part"), "nodes"), "dst_part")
    ids = numbered.select("dst_part", "src", (F.col("r") + F.col("nodes")).alias("remote_id"))
    return cut.select("dst_part", "src", "dst").join(ids, ["dst_part", "src"])


def remap_ids(rows: DataFrame, block: str, id_: str) -> DataFrame:
    """Ids numbered over (block, id) in order, from zero (G2): an id in two blocks gets two numbers."""
    distinct = rows.select(block, id_).distinct()
    sizes = distinct.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(block, F.coalesce(F.sum("n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a block
    inner = running(distinct, [block], [id_], name="__k").join(before, block)
    return rows.join(inner.select(block, id_, (F.col("__before") + F.col("__k")).cast("long").alias("new_id")), [block, id_])


def ranges(volume: DataFrame, to: str = "dst_part", of: str = "src_part") -> DataFrame:
    """(to, of, begin, end): where each owner's rows lie in what a part gets (G3, G7), by running sums."""
    w = Window.partitionBy(to).orderBy(of).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n_rows").over(w)
    return volume.select(to, of, (end - F.col("n_rows")).alias("begin"), end.alias("end"))


def byte_ranges(bits: DataFrame, width: int, group: str, order: str) -> DataFrame:
    """(group, order, begin, end): packed bytes of each row, ceil(bits * width / 8), as running sums."""
    size = F.ceil(F.col("num_bits") * width / 8).cast("long")
    placed = running(bits.select(group, order, "num_bits"), [group], [order], size, "begin")
    return placed.select(group, order, "begin", (F.col("begin") + size).alias("end"))


def byte_splits(bits: DataFrame, width: int, group: str) -> DataFrame:
    """(group, bytes): packed bytes for each rank (G5): the difference of prefix sums, summed directly."""
    return bits.groupBy(group).agg(F.sum(F.ceil(F.col("num_bits") * width / 8).cast("long")).alias("bytes"))


def reversed_plan(planned: DataFrame) -> DataFrame:
    """The plan of the edges turned round (F10): the same rows cross, the other way. What was summed before is now sent once, and the reverse."""
    turned = F.when(F.col("mode") == "pre", "post").otherwise("pre")
    rest = [c for c in planned.columns if c not in ("src", "dst", "src_part", "dst_part", "mode")]
    return planned.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_part").alias("src_part"), F.col("src_part").alias("dst_part"), turned.alias("mode"), *rest)


def aggregate_planned(local: DataFrame, planned: DataFrame, feats: DataFrame, width: int, weight: str | None = None, codec: Codec = PLAIN) -> DataFrame:
    """(node_id, feat): sums over local and cut edges with the cut exchanged as planned.

    Pre: summed by (src_part, dst), and the sums again by dst. Post: each source
    row goes once to a destination part and is joined with that part's edges
    there. Rows that cross are packed by ``codec`` (J15-J20) before the shuffle
    and restored after it; local rows are never touched. All three branches end
    in a table dealt by node, so that joining them moves nothing more.
    """
    keep = [weight] if weight else []
    own = aggregate(local, feats, width, "sum", weight)
    source = feats.select(F.col("node_id").alias("src"), "feat")
    pre = planned.where("mode = 'pre'").select("src", "dst", "src_part", *keep).join(source, "src")
    made = reduced(pre, ["src_part", "dst"], "feat", width, "sum", weight).withColumnRenamed("dst", "node_id")
    if codec.packs:
        made = decode(encode(made, "node_id", width, codec).repartition("node_id"), width, codec)
    pre_sums = reduced(made, ["node_id"], "feat", width)
    post = planned.where("mode = 'post'")
    shipped = demand(post).join(source, "src").select("dst_part", F.col("src").alias("node_id"), "feat")
    edges = post.select("dst_part", F.col("src").alias("node_id"), "dst", *keep)
    if codec.packs:
        arrived = decode(edges.join(encode(shipped, "node_id", width, codec), ["dst_part", "node_id"]), width, codec)
    else:
        arrived = edges.join(shipped, ["dst_part", "node_id"])
    post_sums = reduced(arrived, ["dst"], "feat", width, "sum", weight).withColumnRenamed("dst", "node_id")
    return _joined([own, pre_sums, post_sums])


def _joined(tables: list[DataFrame]) -> DataFrame:
    """The sum by node of tables that have a row a node each and are dealt by node."""
    out = tables[0].withColumnRenamed("feat", "f0")
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumnRenamed("feat", f"f{i}"), "node_id", "full")
    rows = [F.col(f"f{i}") for i in range(len(tables))]
    total = rows[0]
    for r in rows[1:]:
        total = F.when(total.isNull(), r).when(r.isNull(), total).otherwise(F.zip_with(total, r, lambda x, y: x + y))
    return out.select("node_id", total.alias("feat"))
