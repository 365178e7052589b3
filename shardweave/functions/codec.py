"""How feature rows cross between parts (J15-J20): as they are, as 16-bit floats, or as codes of 8, 4 or 2 bits with a zero point and a scale.

A packed row is an array of 64-bit words, the first cell in the lowest bits, and
the two numbers; the shuffle moves nothing else of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.functions.quantise import WIDTHS, assign_bits, bfloat16, codes, params


@dataclass(frozen=True)
class Codec:
    """``bits``: 32 sends rows as they are, 16 as bfloat16, 8, 4 and 2 as codes, 0 as codes whose bits are drawn for each node by ``shares``.

    ``exact``: zero points and scales cross as doubles, else rounded to bfloat16.
    """

    bits: int = 32
    shares: dict[int, float] = field(default_factory=dict)
    epoch: int = 0
    period: int = 1
    exact: bool = True

    @property
    def packs(self) -> bool:
        return self.bits != 32


PLAIN = Codec()


def choose_codec(bits: int, training: bool = True, shares: dict[int, float] | None = None, epoch: int = 0, period: int = 1, exact: bool = True) -> Codec:
    """The codec of a run (J15): nothing is packed outside training; ``shares`` asks for mixed widths."""
    if not training or (bits == 32 and not shares):
        return PLAIN
    if shares:
        return Codec(0, shares, epoch, period, exact)
    if bits not in (16, *WIDTHS):
        raise ValueError(f"bits: 32, 16 or one of {WIDTHS}")
    return Codec(bits, exact=exact)


def pack_words(code: str, bits: int, width: int) -> Column:
    """A column of integer codes as 64-bit words."""
    per = 64 // bits
    cell = lambda j: F.shiftleft(F.get(code, F.lit(j)).cast("long"), j % per * bits)
    return F.array(*[reduce(Column.bitwiseOR, [cell(j) for j in range(w * per, min(width, (w + 1) * per))]) for w in range(-(-width // per))])


def unpack_words(words: str, bits: int, width: int) -> Column:
    per = 64 // bits
    return F.array(*[F.shiftrightunsigned(F.get(words, F.lit(j // per)), j % per * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for j in range(width)])


def half_code(x: Column) -> Column:
    """The 16 bits of x as bfloat16: sign, eight bits of exponent, seven of fraction; ties to even."""
    x = bfloat16(x)
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    whole = F.rint(size / F.pow(F.lit(2.0), F.greatest(power, F.lit(-126)) - 7)).cast("int")  # 128 to 255; less below the least normal number
    bits = F.when(size == 0, 0).when(F.isnan(x), 0x7FC0).when(size >= 2.0**128, 0x7F80).when(power < -126, whole).otherwise((power.cast("int") + 127) * 128 + whole - 128)
    return bits + F.when(x < 0, 0x8000).otherwise(0)


def half_value(code: Column) -> Column:
    exponent, part = F.floor(code / 128) % 256, code % 128
    size = F.when(exponent == 255, F.when(part == 0, float("inf")).otherwise(float("nan"))).when(exponent == 0, part * 2.0**-133).otherwise((part + 128) * F.pow(F.lit(2.0), exponent - 134))
    return F.when(code >= 0x8000, -size).otherwise(size)


def encode(rows: DataFrame, key: str, width: int, codec: Codec) -> DataFrame:
    """``rows`` with (num_bits, zero, scale, packed) instead of feat; ``key`` names the node whose row it is."""
    rest = [c for c in rows.columns if c != "feat"]
    if codec.bits == 16:
        made = rows.select(*rest, F.transform("feat", half_code).alias("__code"))
        return made.select(*rest, F.lit(16).alias("num_bits"), F.lit(0.0).alias("zero"), F.lit(1.0).alias("scale"), pack_words("__code", 16, width).alias("packed"))
    bits = F.lit(codec.bits) if codec.bits else assigned(F.col(key), codec)
    made = rows.withColumn("num_bits", bits.cast("int"))
    made = made.withColumn("__par", params(F.col("feat"), F.col("num_bits")))
    made = made.withColumn("__code", codes(F.col("feat"), F.col("__par")))
    kinds = [codec.bits] if codec.bits else list(WIDTHS)
    packed = reduce(lambda c, b: c.when(F.col("num_bits") == b, pack_words("__code", b, width)), kinds, F)
    sent = (lambda c: c) if codec.exact else bfloat16
    return made.select(*rest, "num_bits", sent(F.col("__par.zero")).alias("zero"), sent(F.col("__par.scale")).alias("scale"), packed.alias("packed"))


def assigned(node: Column, codec: Codec) -> Column:
    return assign_bits(node, codec.shares, codec.epoch, codec.period)


def decode(rows: DataFrame, width: int, codec: Codec) -> DataFrame:
    """``rows`` with feat as doubles instead of what ``encode`` made."""
    rest = [c for c in rows.columns if c not in ("num_bits", "zero", "scale", "packed")]
    if codec.bits == 16:
        opened = rows.select(*rest, unpack_words("packed", 16, width).alias("__code"))
        return opened.select(*rest, F.transform("__code", half_value).alias("feat"))
    kinds = [codec.bits] if codec.bits else list(WIDTHS)
    code = reduce(lambda c, b: c.when(F.col("num_bits") == b, unpack_words("packed", b, width)), kinds, F)
    opened = rows.select(*rest, code.alias("__code"), F.struct("zero", "scale").alias("__par"))
    return opened.select(*rest, F.transform("__code", lambda c: c * F.col("__par.scale") + F.col("__par.zero")).alias("feat"))
