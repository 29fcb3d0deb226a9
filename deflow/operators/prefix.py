"""Running values over ordered streams that may contain one enormous key.

A plain window puts a whole key in one task. Here the order is cut into segments: each segment is
scanned on its own, one carry row per segment is scanned across segments, and the carry is joined
back. The plan is the same for keys of every size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 1_000_000  # rows a single task may scan for one key before the key is segmented


@dataclass(frozen=True)
class Order:
    """Ordering of a stream: ``position`` is integral and rises with time; ``columns`` break ties."""

    position: Column
    columns: list


def segment_width(df: DataFrame, keys: list[str], position: Column, target_rows: int = TARGET_ROWS) -> int:
    """Width in ``position`` units that keeps segments of the densest key near ``target_rows``.

    A small key has one segment, by the same plan. One aggregate with map-side combine.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    widest = per_key.agg(F.min((F.col("hi") - F.col("lo") + 1) * F.lit(target_rows) / F.col("n")).alias("w")).first()["w"]
    return max(1, int(widest or 1))


def running(df: DataFrame, keys: list[str], order: Order, values: dict, width: int) -> DataFrame:
    """Add running columns over rows strictly before the current one within ``keys``.

    ``values`` maps an output name to ``("sum", column)`` or ``("last", column)``; ``last`` skips nulls.
    """
    agg = {"sum": lambda c: F.sum(c), "last": lambda c: F.last(c, ignorenulls=True)}
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_seg", F.floor(order.position / F.lit(width)))
    w = before(Window.partitionBy(*keys, "_seg").orderBy(*order.columns))
    local = d.select("*", *[agg[k](c).over(w).alias(f"_l_{n}") for n, (k, c) in values.items()])
    rank = F.struct(*order.columns)
    ends = d.groupBy(*keys, "_seg").agg(*[
        (F.sum(c) if k == "sum" else F.max_by(c, F.when(c.isNotNull(), rank))).alias(f"_e_{n}")
        for n, (k, c) in values.items()])
    across = before(Window.partitionBy(*keys).orderBy("_seg"))
    carry = ends.select(*keys, "_seg", *[agg[k](F.col(f"_e_{n}")).over(across).alias(f"_c_{n}") for n, (k, _) in values.items()])
    cond = [local[k].eqNullSafe(carry[k]) for k in keys + ["_seg"]]
    joined = local.join(carry, cond, "inner")
    picked = []
    for n, (k, _) in values.items():
        mine, prior = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        picked.append((F.coalesce(mine, F.lit(0)) + F.coalesce(prior, F.lit(0)) if k == "sum" else F.coalesce(mine, prior)).alias(n))
    return joined.select(*[local[c] for c in df.columns], *picked)
