"""Affine quantisation and bit packing of feature rows.

A row's zero point is its minimum and its scale the spread over 2^bits - 1 (one
where there is no spread); a code is rint((x - zero) / scale), ties to even. All
arithmetic is in doubles; packed bytes are integers of 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.normalise import bind
from shardweave.operators.running import running

WIDTHS = (8, 4, 2)


def params(feat: Column, bits: Column) -> Column:
    """(zero, scale) of a row."""
    low, high = F.array_min(feat).cast("double"), F.array_max(feat).cast("double")
    levels = (F.shiftleft(F.lit(1), bits) - 1).cast("double") if isinstance(bits, int) else F.pow(F.lit(2.0), bits) - 1
    return bind((high - low) / levels, lambda s: F.struct(low.alias("zero"), F.when(s == 0, 1.0).otherwise(s).alias("scale")))


def codes(feat: Column, par: Column) -> Column:
    return bind(par, lambda p: F.transform(feat, lambda x: F.rint((x.cast("double") - p["zero"]) / p["scale"]).cast("int")))


def restore(code: Column, par: Column) -> Column:
    """Values of codes: code * scale + zero."""
    return bind(par, lambda p: F.transform(code, lambda c: c * p["scale"] + p["zero"]))


def quantise(rows: DataFrame, bits: Column) -> DataFrame:
    """``rows`` (node_id, feat) with num_bits, par and code."""
    out = rows.withColumn("num_bits", bits.cast("int")).withColumn("par", params(F.col("feat"), F.col("num_bits")))
    return out.withColumn("code", codes(F.col("feat"), F.col("par")))


def pack_big(code: Column, bits: Column, width: int) -> Column:
    """Codes along a row, the first in a byte's high bits, the last byte filled from the left (K5)."""
    per = F.floor(F.lit(8) / bits).cast("int")
    n = F.ceil(width * bits / 8).cast("int")

    def byte(code: Column, i: Column) -> Column:
        mine = F.transform(F.sequence(F.lit(0), per - 1), lambda k: F.coalesce(F.get(code, (i * per + k).cast("int")), F.lit(0)))
        return F.aggregate(mine, F.lit(0), lambda s, c: (s * F.pow(F.lit(2), bits).cast("int") + c).cast("int"))

    return bind(code, lambda code: F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte(code, i)))


def unpack_big(packed: Column, bits: Column, width: int) -> Column:
    per = F.floor(F.lit(8) / bits).cast("int")
    step = F.pow(F.lit(2), bits).cast("int")
    code = lambda packed, j: (F.floor(F.get(packed, F.floor(j / per).cast("int")) / F.pow(F.lit(2), (per - 1 - j % per) * bits)) % step).cast("int")
    return bind(packed, lambda packed: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: code(packed, j)))


def pack_little(feat: Column, scale: Column, zero: Column, bits: int, width: int) -> Column:
    """Along a row, the first code in the low bits, zero point in code space: rint(x / scale + zero), kept within bits (K4)."""
    per, top = 8 // bits, (1 << bits) - 1
    code = F.transform(feat, lambda x: F.least(F.greatest(F.rint(x.cast("double") / scale + zero), F.lit(0.0)), F.lit(float(top))).cast("int"))

    def byte(code: Column, i: Column) -> Column:
        return sum((F.coalesce(F.get(code, (i * per + k).cast("int")), F.lit(0)) * (1 << (bits * k)) for k in range(per)), F.lit(0))

    return bind(code, lambda code: F.transform(F.sequence(F.lit(0), F.lit(-(-width // per) - 1)), lambda i: byte(code, i)))


def restore_little(packed: Column, scale: Column, zero: Column, bits: int, width: int) -> Column:
    """(code - zero) * scale (K4)."""
    per = 8 // bits
    code = lambda packed, j: F.floor(F.get(packed, F.floor(j / per).cast("int")) / F.pow(F.lit(2), (j % per) * bits)) % (1 << bits)
    return bind(packed, lambda packed: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: (code(packed, j) - zero) * scale))


def pack_down(quantised: DataFrame, rank: str, bits: int, width: int) -> DataFrame:
    """(rank, byte_row, packed): 8 / bits consecutive nodes of a rank share a byte a column, the first in the high bits (K1, K2).

    Ranks are padded apart. Nodes are in order of node_id within their rank.
    """
    per = 8 // bits
    at = running(quantised.select(rank, "node_id", "code"), [rank], ["node_id"], name="__k")
    shift = F.lit(per - 1) - F.col("__k") % per
    cells = [F.bit_or(F.get("code", F.lit(j)) * F.pow(F.lit(2), shift * bits).cast("int")).alias(f"c{j}") for j in range(width)]
    rows = at.groupBy(rank, F.floor(F.col("__k") / per).cast("long").alias("byte_row")).agg(*cells)
    return rows.select(rank, "byte_row", F.array(*[f"c{j}" for j in range(width)]).alias("packed"))


def unpack_down(packed: DataFrame, nodes: DataFrame, rank: str, bits: int) -> DataFrame:
    """(node_id, par, restored values as feat) from packed rows and the nodes' (rank, node_id, par)."""
    per = 8 // bits
    at = running(nodes.select(rank, "node_id", "par"), [rank], ["node_id"], name="__k")
    at = at.withColumn("byte_row", F.floor(F.col("__k") / per).cast("long"))
    shift = F.pow(F.lit(2), (F.lit(per - 1) - F.col("__k") % per) * bits)
    code = F.transform("packed", lambda b: F.floor(b / shift) % (1 << bits))
    return at.join(packed, [rank, "byte_row"]).select("node_id", "par", restore(code, F.col("par")).alias("feat"))


def buffer_size(n: Column, bits: int, width: int) -> Column:
    """Bytes of a packed buffer: ceil(n / (8 / bits)) * width (K8)."""
    return (F.ceil(n / (8 // bits)) * width).cast("long")


def share(node: Column, salt: int = 0) -> Column:
    """A number in [0, 1) for an id, the same every time: a linear congruence of it. Ids of any size and sign."""
    return ((F.pmod(node + salt, F.lit(1 << 31)) * 1103515245 + 12345) % 2147483648) / 2147483648.0


def scatter(x: Column) -> Column:
    """A number in [0, 2^31) for an integer, far from those of its neighbours: shifts, exclusive ors and products, which SQL has too."""
    x = F.pmod(x, F.lit(1 << 31))
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)) * 73244475 % 2147483648
    return x.bitwiseXOR(F.shiftright(x, 16))


def assign_bits(node: Column, shares: dict[int, float] | int, epoch: int = 0, period: int = 1) -> Column:
    """Bits of a node: one width for all, or drawn by ``shares`` of 8, 4 and 2 bits and drawn anew every ``period`` epochs (K9, M2)."""
    if isinstance(shares, int):
        return F.lit(shares)
    u, total, at, pick = share(node, epoch // period), sum(shares.values()), 0.0, F
    for bits, p in shares.items():
        at += p / total
        pick = pick.when(u < at, bits)
    return pick.otherwise(list(shares)[-1])


def bfloat16(x: Column) -> Column:
    """x to eight significant bits, ties to even, as the exchange sends 16-bit floats (C14, Q13)."""
    x = x.cast("double")
    guess = F.floor(F.log2(F.abs(x))).cast("double")
    power = F.when(F.pow(F.lit(2.0), guess) > F.abs(x), guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= F.abs(x), guess + 1).otherwise(guess)
    unit = F.pow(F.lit(2.0), power - 7)
    return F.when(x == 0, F.lit(0.0)).when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x / unit) * unit)
