"""Queries over versioned record sets and over logs that are found by more than one way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.operators.matching import fallback_match, normalised
from deflow.plans.records import FAIL, failures
from deflow.plans.registry import query
from deflow.session import checkpoint_dir
from deflow.sources.derived import table
from deflow.sources.records import feedback_instances
from deflow.sources.store import RecordStore


def new_store(spark: SparkSession, key: str = "instance_id") -> RecordStore:
    return RecordStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", key)


@query("record_store", FAIL + """, first AS (SELECT instance_id, category FROM fail WHERE would_catch <> 'no'),
edits AS (SELECT instance_id, which_property AS category FROM fail WHERE would_catch IN ('no', 'yes')),
merged AS (SELECT * FROM edits UNION ALL SELECT * FROM first WHERE instance_id NOT IN (SELECT instance_id FROM edits)),
again AS (SELECT instance_id, category || '!' AS category FROM merged)
SELECT coalesce(f.instance_id, l.instance_id) AS instance_id, f.category AS first_category, l.category AS last_category
FROM first f FULL JOIN (SELECT * FROM again WHERE instance_id IN (SELECT instance_id FROM fail WHERE patch_source <> 'gold')) l
  ON l.instance_id = f.instance_id""")
def q_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as a set that is begun, merged into, read and written back to its own path, and pruned; first and last version."""
    f = failures(spark, sf_dir)
    store = new_store(spark)
    store.replace(f.where("would_catch <> 'no'").select("instance_id", "category"))
    store.merge(f.where("would_catch IN ('no', 'yes')").select("instance_id", F.col("which_property").alias("category")))
    store.replace(store.read().withColumn("category", F.concat("category", F.lit("!"))))
    store.remove(f.where("patch_source = 'gold'"))
    first = store.read(1).withColumnRenamed("category", "first_category")
    return first.join(store.read().withColumnRenamed("category", "last_category"), "instance_id", "full")


@query("feedback_instances", """SELECT b.item_id AS instance_id, coalesce(d.source, '') AS repo, coalesce(d.lang, '') AS base_commit,
  coalesce(d.text, '') AS problem_statement, coalesce(CAST(d.n_chars AS VARCHAR), '') AS gold_patch
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def q_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as feedback, documents as the labelled set of a store: one instance per item."""
    none = F.array().cast("array<string>")
    labeled = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("instance_id"), F.col("source").alias("repo"), F.col("lang").alias("base_commit"), F.col("text").alias("problem_statement"),
        F.col("n_chars").cast("string").alias("patch"), none.alias("fail_to_pass"), none.alias("pass_to_pass"))
    store = new_store(spark)
    store.replace(labeled)
    feedback = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("instance_id"))
    return feedback_instances(feedback, store.read()).drop("fail_to_pass", "pass_to_pass")


_LOG = """CASE WHEN length(source) % 2 = 0 AND n_chars % 3 = 0 THEN doc_id END AS id,
  CASE WHEN n_chars % 3 <= 1 THEN concat(source, '/', n_chars) END AS path"""
_NORMAL = "trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("fallback_logs", f"""WITH l AS (SELECT doc_id, text, {_LOG} FROM documents),
by_id AS (SELECT id, max(doc_id) AS log FROM l GROUP BY id),
by_path AS (SELECT path, max(doc_id) AS log FROM l GROUP BY path),
by_text AS (SELECT {_NORMAL} AS t, max(doc_id) AS log FROM documents GROUP BY 1),
c AS (SELECT doc_id, concat(source, '/', n_chars) AS path, {_NORMAL} AS t FROM documents)
SELECT c.doc_id, coalesce(i.log, p.log, t.log) AS matched,
  CASE WHEN i.log IS NOT NULL THEN 1 WHEN p.log IS NOT NULL THEN 2 WHEN t.log IS NOT NULL THEN 3 END AS way
FROM c LEFT JOIN by_id i ON i.id = c.doc_id LEFT JOIN by_path p ON p.path = c.path LEFT JOIN by_text t ON t.t = c.t AND t.t <> ''""")
def q_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each document by its id, else by its path, else by its text, which the logs hold with other blanks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    logs = d.selectExpr("doc_id AS log", *[c.strip() for c in _LOG.split(",\n")], "concat(' ', replace(text, ' ', '  ')) AS text")
    ways = [(F.col("doc_id"), F.col("id")), (F.concat("source", F.lit("/"), "n_chars"), F.col("path")), (normalised("text"), normalised("text"))]
    return fallback_match(d, logs, ways, "doc_id", "log", "log")
