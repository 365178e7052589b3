"""Numbers and running sums in order, in two levels: within ranges of the ordering id, and over the totals of the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a group's ids are dealt into; a task orders a range, never a group.
RANGES = 1024


def running(rows: DataFrame, by: list[str], order: list[str], weight: Column | None = None, name: str = "before", ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: what the rows of the same group before this one weigh together (G1-G4, G6); without ``weight``, how many they are.

    ``order`` starts with an integer column, by whose range rows are dealt; the
    columns after it break ties. Groups and the integer are not null.
    """
    w = (F.lit(1) if weight is None else weight).cast("long")
    key, plain = order[0], rows.columns
    span = rows.groupBy(*by).agg(F.min(key).cast("double").alias("__low"), (F.max(key).cast("double") - F.min(key) + 1).alias("__wide"))
    at = rows.withColumn("__w", w)
    at = at.join(span, by) if by else at.crossJoin(F.broadcast(span))  # without groups, one row
    at = at.withColumn("__range", F.floor((F.col(key) - F.col("__low")) / F.col("__wide") * ranges).cast("int"))
    group = [*by, "__range"]
    totals = at.groupBy(*group).agg(F.sum("__w").alias("__all"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # ``ranges`` rows a group at most
    before = totals.select(*group, F.coalesce(F.sum("__all").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = at.withColumn("__inner", F.coalesce(F.sum("__w").over(inside), F.lit(0))).join(before, group)
    return found.select(*plain, (F.col("__before") + F.col("__inner")).cast("long").alias(name))
