"""Golden-corpus evaluation: all cases, broken and fixed, in one analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deflow.operators.diff import diff
from deflow.operators.experiments import match_expected
from deflow.operators.shaping import findings, opaque_steps, with_root
from deflow.operators.solver import place, solve
from deflow.operators.witness import witnesses
from deflow.sources.code import read_tapes


def evaluate(specs: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per case: expected, caught, new regressions of the fixed version, witness quality.

    ``texts`` has ``path`` as named in the specs (see ``records.relative_to``) and ``text``; a case whose files
    have no text says so in ``error``. Latency is for the caller to measure. Every case is two workspaces of its own,
    ``id`` and ``id#fixed``, so equal function names in different cases cannot hide each other.
    """
    listed = specs.select("id", "primary_file", "fixed_files", F.explode("files").alias("f")).select(
        "id", "primary_file", "fixed_files", F.col("f.path").alias("uri"))
    fixed = F.get(F.filter("fixed_files", lambda x: x["role"] == "fixed"), F.lit(0))["path"]
    broken = listed.select(F.col("id").alias("ws"), "uri", F.col("uri").alias("path"))
    repaired = listed.where(fixed.isNotNull()).select(
        F.concat("id", F.lit("#fixed")).alias("ws"), "uri",
        F.when(F.col("uri") == F.col("primary_file"), fixed).otherwise(F.col("uri")).alias("path"))
    found = broken.unionByName(repaired).join(texts.select("path", "text"), "path", "left")
    lost = found.where("text IS NULL").groupBy(F.regexp_replace("ws", "#fixed$", "").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("lost"))
    solved = solve(place(read_tapes(found.where("text IS NOT NULL").select("ws", "uri", "text"))))
    before = solved.regressions.where(~F.col("ws").endswith("#fixed"))
    after = solved.regressions.where(F.col("ws").endswith("#fixed")).withColumn("ws", F.regexp_replace("ws", "#fixed$", ""))
    has_fix = specs.where(fixed.isNotNull()).select(F.col("id").alias("ws"))
    fresh = diff(before.join(has_fix, "ws", "left_semi"), after).where("change = 'new'").groupBy(F.col("ws").alias("id")).agg(F.count(F.lit(1)).alias("fp_new"))
    primary = specs.select(F.col("id").alias("ws"), F.col("primary_file").alias("uri"))
    mine = witnesses(solved, before.join(primary, ["ws", "uri"], "left_semi"))
    quality = mine.groupBy(F.col("ws").alias("id")).agg(F.count(F.lit(1)).alias("witnesses"), F.count_if(opaque_steps() == 0).alias("concrete"))
    expected = specs.select(F.col("id").alias("case"), F.coalesce("expect_dedup", F.lit(False)).alias("dedup"), F.explode("expected_regressions").alias("x")).select(
        "case", "x.symbol", "x.kind", "dedup")
    caught = match_expected(expected, mine.select(F.col("ws").alias("case"), "symbol", "kind")).withColumnRenamed("case", "id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (specs.select("id", "name").join(caught, "id", "left").join(fresh, "id", "left").join(quality, "id", "left").join(lost, "id", "left")
            .select("id", "name", zero("expected"), zero("caught"), zero("fp_new"), zero("witnesses"), zero("concrete"),
                    (F.coalesce("caught", F.lit(0)) >= F.coalesce("expected", F.lit(0))).alias("catch_ok"),
                    (F.coalesce("fp_new", F.lit(0)) == 0).alias("fp_ok"), F.lit(None).cast("double").alias("latency_ms"),
                    F.when(F.col("lost").isNotNull(), F.concat(F.lit("no text for "), "lost")).otherwise("").alias("error")))


def sweep(sources: DataFrame) -> DataFrame:
    """False-positive sweep: every instance is a workspace with one file; ``fired`` when it has findings.

    ``sources``: instance_id, uri, text (null when the file could not be had).
    """
    solved = solve(place(read_tapes(sources.where("text IS NOT NULL").withColumnRenamed("instance_id", "ws"))))
    found = findings(with_root(witnesses(solved)), ["ws"]).groupBy(F.col("ws").alias("instance_id")).agg(
        F.count(F.lit(1)).alias("n_regressions"), F.count_if(F.col("confidence") == "high").alias("n_high"),
        F.collect_set("confidence").alias("confidences"))
    return sources.select("instance_id", "uri", F.col("text").isNotNull().alias("fetched")).join(found, "instance_id", "left").select(
        "instance_id", F.col("uri").alias("filepath"), "fetched", F.coalesce(F.col("n_regressions") > 0, F.lit(False)).alias("fired"),
        F.coalesce("n_regressions", F.lit(0)).alias("n_regressions"), F.coalesce("n_high", F.lit(0)).alias("n_high"),
        F.coalesce("confidences", F.array().cast("array<string>")).alias("confidences"),
        F.when(F.col("fetched"), "").otherwise("fetch failed").alias("error"))
