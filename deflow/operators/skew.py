"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 64      # a key is hot when it holds more than 1/64 of all rows


def hot_keys(df: DataFrame, on: list[str], share: int = HOT_SHARE) -> list[tuple]:
    """Keys holding more than ``1/share`` of ``df``: fewer than ``share`` of them can exist.

    Counting combines map-side, so a hot key costs one partial row per task. A null matches nothing and is
    no key.
    """
    counts = df.groupBy(*on).count()
    rows = counts.dropna(subset=on).orderBy(F.desc("count")).limit(share).collect()
    total = df.count()
    return [tuple(r[k] for k in on) for r in rows if r["count"] > total / share]


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """Equi-join against a ``right`` that is unique on ``on``.

    Rows of hot keys meet a broadcast of just those keys' right rows (at most one row per hot key,
    so fewer than ``HOT_SHARE`` rows); everything else takes the ordinary shuffled join. Without hot keys that is all rows.
    """
    if hot is None:
        hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    keys = left.sparkSession.createDataFrame(hot, left.select(*on).schema)
    hot_right = right.join(F.broadcast(keys), on, "left_semi")
    is_hot = left.join(F.broadcast(keys), on, "left_semi")
    cold = left.join(F.broadcast(keys), on, "left_anti")
    return is_hot.join(F.broadcast(hot_right), on, how).unionByName(cold.join(right, on, how))


def rank_in_group(df: DataFrame, keys: list[str], order: list, segment: Column, out: str) -> DataFrame:
    """1-based row number within ``keys`` by ``order``, without gathering a group in one task.

    ``segment`` must rise with ``order``: rows are numbered inside each segment and shifted by the
    number of rows in the segments before it, which is a running sum over one row per segment.
    """
    d = df.withColumn("_seg", segment)
    offsets = d.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)))
    cond = [numbered[k].eqNullSafe(offsets[k]) for k in keys + ["_seg"]]
    joined = numbered.join(offsets, cond, "inner")
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_before")).cast("long").alias(out))
