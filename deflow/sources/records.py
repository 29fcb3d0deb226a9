"""Experiment records on disk: explicit schemas, tolerant readers, versioned sets and upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from deflow.sources.store import RecordStore

LABELED = """instance_id string, repo string, base_commit string, problem_statement string, patch string, patch_source string,
 fail_to_pass array<string>, pass_to_pass array<string>, test_results map<string,string>, category string, would_catch string,
 which_property string, analysis_note string, labeled_by string, label_timestamp string"""
# What a missing field of a labelled record means.
LABELED_DEFAULTS = {"repo": "", "base_commit": "", "problem_statement": "", "patch": "", "patch_source": "gold",
                    "category": "unlabeled", "would_catch": "unknown", "which_property": "none", "analysis_note": "",
                    "labeled_by": "human", "label_timestamp": ""}
FEEDBACK = """instance_id string, feedback_text string, category string, which_property string, confidence string,
 is_analyzable boolean, gold_patch string, recorded_by string, record_timestamp string"""
_ARM = "struct<success:boolean,iterations:int,patch_coverage_score:double,buggy_file_fetched:boolean,latency_ms:array<double>,error:string>"
PAIR = f"instance_id string, filepath string, oracle {_ARM}, ablation {_ARM}"
_TESTS = "struct<success:array<string>,failure:array<string>>"
REPORT = f"map<string,struct<patch_is_None:boolean,patch_successfully_applied:boolean,resolved:boolean,tests_status:struct<FAIL_TO_PASS:{_TESTS},PASS_TO_PASS:{_TESTS}>>>"
SESSION = """instance_id string, arm string, setup_complete boolean, cold_start_error string, rpc_errors int, last_rpc_error string,
 cold_start_ms double, total_ms double, files_registered int, findings array<struct<step:int,changed_files:array<string>,latency_ms:double>>"""
SPEC = """id string, name string, description string, analysis_note string, files array<struct<role:string,path:string>>, primary_file string,
 fixed_files array<struct<role:string,path:string>>, should_detect boolean, expected_regressions array<struct<func:string,symbol:string,kind:string>>,
 expect_dedup boolean, value_flow_symbol string, task string"""


def _read(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON with a fixed schema; a path that does not exist is an error."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _complete(d: DataFrame) -> DataFrame:
    """Labelled records with all columns; missing fields take their defaults."""
    have = set(d.columns)
    schema = StructType.fromDDL(LABELED)
    d = d.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    empty = F.array().cast("array<string>")
    return d.where("instance_id IS NOT NULL").fillna(LABELED_DEFAULTS).withColumn("fail_to_pass", F.coalesce("fail_to_pass", empty)).withColumn(
        "pass_to_pass", F.coalesce("pass_to_pass", empty)).withColumn(
        "test_results", F.coalesce("test_results", F.expr("cast(map() AS map<string,string>)")))


def load_labeled(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Labelled failures from a store that ``save_labeled`` wrote, else from JSON lines, whose blank lines are skipped.

    A set that nobody has begun yet is empty: of all readers, only this one accepts a missing path.
    """
    stored = RecordStore(spark, path).read(version)
    if stored is not None:
        return _complete(stored)
    try:
        return _complete(_read(spark, path, LABELED))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    return _complete(spark.createDataFrame([], LABELED))


def save_labeled(df: DataFrame, path: str) -> None:
    """Replace the set by a new version; until it is complete, and if it never is, readers see the old one.

    ``df`` may come from the same path. One row per instance stays.
    """
    RecordStore(df.sparkSession, path).replace(_complete(df))


def merge_labeled(df: DataFrame, path: str) -> None:
    """Put records into the set, in place of those of the same instances; only the parts they fall into are rewritten.

    A set that is still plain JSON lines is taken over as the first version.
    """
    store = RecordStore(df.sparkSession, path)
    if store.version() is None:
        store.replace(load_labeled(df.sparkSession, path))
    store.merge(_complete(df))


def upsert(existing: DataFrame, new: DataFrame, key: str = "instance_id") -> DataFrame:
    """``existing`` without the keys of ``new``, then ``new``."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def load_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object per file."""
    return _read(spark, folder, FEEDBACK, True)


def feedback_instances(feedback: DataFrame, labeled: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Instances that have feedback, with what the labelled record of each tells; without one, fields are empty.

    ``ids`` keeps only instances it names. One row per feedback record; ``labeled`` has one row per instance.
    """
    if ids is not None:
        feedback = select_instances(feedback, ids)
    texts = ["repo", "base_commit", "problem_statement"]
    d = feedback.select("instance_id").join(labeled.select("instance_id", *texts, "fail_to_pass", "pass_to_pass", F.col("patch").alias("gold_patch")), "instance_id", "left")
    return d.select("instance_id", *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
                    *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("fail_to_pass", "pass_to_pass")],
                    F.coalesce("gold_patch", F.lit("")).alias("gold_patch"))


def load_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Arm pairs flattened to the columns of ``experiments.coverage_lift``; ``legacy`` marks rows without scores."""
    d = _read(spark, folder, PAIR, True).where("instance_id IS NOT NULL")
    arm = lambda a, p: [F.coalesce(f"{a}.success", F.lit(False)).alias(f"{p}_success"), F.col(f"{a}.patch_coverage_score").alias(f"{p}_cov"),
                        F.col(f"{a}.error").alias(f"{p}_error"), F.col(f"{a}.iterations").alias(f"{p}_iterations"),
                        F.coalesce(f"{a}.latency_ms", F.array().cast("array<double>")).alias(f"{p}_latency_ms")]
    return d.select("instance_id", "filepath", *arm("oracle", "g"), *arm("ablation", "a"),
                    (F.col("oracle.patch_coverage_score").isNull() | F.col("ablation.patch_coverage_score").isNull()).alias("legacy"))


def recompute_coverage(pairs: DataFrame, outputs: DataFrame, feedback: DataFrame, coverage) -> DataFrame:
    """Scores recomputed from saved outputs where both output and gold patch exist.

    ``outputs``: instance_id, arm (``g``/``a``), text. ``coverage(patch, output)`` gives the column.
    """
    scored = outputs.join(feedback.select("instance_id", "gold_patch"), "instance_id").where("gold_patch <> ''").select(
        "instance_id", "arm", coverage("gold_patch", "text").alias("cov"))
    wide = scored.groupBy("instance_id").agg(F.max(F.when(F.col("arm") == "g", F.col("cov"))).alias("g_new"),
                                             F.max(F.when(F.col("arm") == "a", F.col("cov"))).alias("a_new"))
    return pairs.join(wide, "instance_id", "left").withColumn("g_cov", F.coalesce("g_new", "g_cov")).withColumn(
        "a_cov", F.coalesce("a_new", "a_cov")).drop("g_new", "a_new")


def load_reports(spark: SparkSession, folder: str, pattern: str = "report.json") -> DataFrame:
    """Evaluator reports ``.../<instance_id>/report.json``; invalid JSON is a row with an error, not a failure.

    A report is keyed by instance; when the key is missing its first value counts.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    d = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("instance_id"),
                   F.from_json("value", REPORT).alias("m"), F.get_json_object("value", "$").isNull().alias("bad"))
    inst = F.coalesce(F.expr("m[instance_id]"), F.expr("get(map_values(m), 0)"))
    size = lambda kind, side: F.when(inst["tests_status"][kind][side].isNull(), 0).otherwise(F.size(inst["tests_status"][kind][side]))
    return d.select("instance_id", F.coalesce(inst["resolved"], F.lit(False)).alias("resolved"),
                    size("FAIL_TO_PASS", "success").alias("ftp_pass"), size("FAIL_TO_PASS", "failure").alias("ftp_fail"),
                    size("PASS_TO_PASS", "success").alias("ptp_pass"), size("PASS_TO_PASS", "failure").alias("ptp_fail"),
                    F.when(F.col("bad"), "report.json was not valid JSON").otherwise("").alias("error"))


def latest_run(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Run folder per arm: the manifest's, else the most recently modified.

    ``files``: arm, run_id, modified; ``manifest``: arm, run_id.
    """
    newest = files.groupBy("arm").agg(F.max_by("run_id", "modified").alias("newest"))
    if manifest is None:
        return newest.select("arm", F.col("newest").alias("run_id"))
    return newest.join(manifest, "arm", "left").select("arm", F.coalesce("run_id", "newest").alias("run_id"))


def load_sessions(spark: SparkSession, folder: str, total: str = "total_ms") -> DataFrame:
    """Session logs; ``total`` is the name that the logs give to the summed latency."""
    d = _read(spark, folder, SESSION.replace("total_ms", f"`{total}`"), True)
    return d.withColumnRenamed(total, "total_ms")


def fired(sessions: DataFrame) -> DataFrame:
    """Whether a session had any finding, new or fixed."""
    return sessions.select("instance_id", (F.size(F.coalesce("findings", F.expr("cast(array() AS array<struct<step:int,changed_files:array<string>,latency_ms:double>>)"))) > 0).alias("fired"))


def load_specs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, SPEC, True)


def load_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files as ``path, text``."""
    return spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def relative_to(texts: DataFrame, folder: str) -> DataFrame:
    """``texts`` with paths below ``folder``, as specs name them, instead of whole addresses."""
    place = re.sub(r"^[a-zA-Z][\w+.-]*:/*", "/", folder).rstrip("/") + "/"
    return texts.withColumn("path", F.substr("path", F.instr(F.col("path"), place) + F.lit(len(place))))


def string_list(column: str) -> Column:
    """A list that may arrive as JSON text."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def partition_instances(instances: DataFrame) -> DataFrame:
    """Benchmark instances with their held-out and visible tests as lists."""
    return instances.select("instance_id", "repo", "base_commit", "problem_statement",
                            string_list("FAIL_TO_PASS").alias("fail_to_pass"), string_list("PASS_TO_PASS").alias("pass_to_pass"),
                            F.coalesce("patch", F.lit("")).alias("gold_patch"))


def select_instances(df: DataFrame, ids: DataFrame | None = None, repo: str | None = None, n: int | None = None) -> DataFrame:
    """By id set and repository substring, then the first ``n`` by id."""
    if ids is not None:
        df = df.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    if repo is not None:
        df = df.where(F.col("repo").contains(repo))
    return df if n is None else df.orderBy("instance_id").limit(n)


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A shuffle that the same seed always repeats: order by a hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)


def collect_gold(instances: DataFrame, n: int, skip: DataFrame, seed: int = 42) -> DataFrame:
    """``n`` instances not collected yet, as unlabelled records."""
    fresh = anti_resume(partition_instances(instances), skip)
    return seeded_order(fresh, "instance_id", seed).limit(n).withColumn("patch_source", F.lit("gold")).withColumn("category", F.lit("unlabeled"))


def collect_agent(results: DataFrame, skip: DataFrame) -> DataFrame:
    """Failures of the ablation arm; resolved instances are kept only when they broke a passing test.

    ``results``: instance_id, resolved, fail_to_pass and pass_to_pass as maps test -> passed.
    """
    d = anti_resume(results, skip)
    broke = F.exists(F.map_values("pass_to_pass"), lambda v: ~v)
    lost = F.forall(F.map_values("fail_to_pass"), lambda v: ~v)
    source = F.when(broke, "agent_regressed").when(F.col("resolved"), F.lit(None)).when(lost, "agent_failed").otherwise("agent_partial")
    outcome = lambda m: F.transform_values(m, lambda k, v: F.when(v, "PASSED").otherwise("FAILED"))
    # A test named in both maps takes its pass-to-pass outcome.
    only_ftp = F.map_filter("fail_to_pass", lambda k, v: ~F.map_contains_key("pass_to_pass", k))
    return d.withColumn("patch_source", source).where("patch_source IS NOT NULL").select(
        "instance_id", "patch_source", F.map_concat(outcome(only_ftp), outcome("pass_to_pass")).alias("test_results"),
        F.map_keys("fail_to_pass").alias("fail_to_pass"), F.map_keys("pass_to_pass").alias("pass_to_pass"))


def anti_resume(work: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Work without a result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def orphans(records: DataFrame, known: DataFrame, key: str = "instance_id") -> DataFrame:
    """Records of instances that ``known`` does not have, with their number per instance."""
    return records.join(known.select(key).distinct(), key, "left_anti").groupBy(key).count()


def in_both(a: DataFrame, b: DataFrame, key: str = "instance_id") -> DataFrame:
    """Instances that both have, each once."""
    return a.select(key).intersect(b.select(key))
