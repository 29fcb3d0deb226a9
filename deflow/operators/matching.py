"""Joins that fall back from one way of matching to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(column: str) -> Column:
    """Text without differences of case and of blanks."""
    return F.trim(F.regexp_replace(F.lower(column), "[ \t\r\n]+", " "))


def fallback_match(left: DataFrame, right: DataFrame, ways: list[tuple[Column, Column]], left_key: str, right_key: str, order: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` that the first possible way finds, and the way's number from 1.

    A way is an expression over ``left`` and one over ``right`` that must be equal; null and empty values match
    nothing. Of several rows of ``right`` with one value, the one with the highest ``order``, then key, answers for
    all, so a frequent value makes no pairs. All ways go through one join on (way, value). Without any match, both
    are null. ``left_key`` tells rows apart.
    """
    def offers(df: DataFrame, side: int, *columns: Column) -> DataFrame:
        values = F.array(*[w[side].cast("string") for w in ways])
        return df.select(*columns, F.posexplode(values).alias("way", "value")).where("value <> ''")

    answers = offers(right, 1, F.col(right_key).alias("r"), F.col(order).alias("o")).groupBy("way", "value").agg(
        F.max_by("r", F.struct("o", "r")).alias("r"))
    hits = offers(left, 0, F.col(left_key).alias("l")).join(answers, ["way", "value"])
    best = hits.groupBy("l").agg(F.min("way").alias("way"), F.min_by("r", "way").alias("r"))
    return left.select(F.col(left_key).alias("l")).join(best, "l", "left").select(
        F.col("l").alias(left_key), F.col("r").alias("matched"), (F.col("way") + 1).alias("way"))
