import itertools
import json
import math
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from deflow.functions import lattice, patches
from deflow.operators import experiments as ex
from deflow.plans import corpus
from deflow.sources import records
from deflow.sources.code import read_python_tree


def test_lattice_laws(spark):
    triples = list(itertools.product((1, 2, 3), repeat=3))
    df = spark.createDataFrame(triples, "a int, b int, c int")
    j = lattice.join_values
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    laws = df.select((j(a, b) == j(b, a)).alias("x"), (j(a, a) == a).alias("y"), (j(a, j(b, c)) == j(j(a, b), c)).alias("z"), (j(a, F.lit(1)) == 1).alias("u"))
    assert all(all(r) for r in laws.collect())


def test_labeled_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    assert records.load_labeled(spark, path).count() == 0
    (tmp_path / "one.jsonl").write_text('{"instance_id": "a", "category": "other"}\n\n{"instance_id": "b", "test_results": {"t": "FAILED"}, "pass_to_pass": ["t", "u"], "fail_to_pass": ["t", "z"]}\n')
    d = records.load_labeled(spark, str(tmp_path / "one.jsonl"))
    row = d.where("instance_id = 'a'").first()
    assert row["which_property"] == "none" and row["patch_source"] == "gold" and row["fail_to_pass"] == []
    b = d.where("instance_id = 'b'").select(ex.failed_held_out().alias("h"), ex.broke_passing().alias("p"), ex.is_labeled().alias("l")).first()
    assert b["h"] == ["t", "z"] and b["p"] == ["t"] and b["l"] is False
    records.save_labeled(d, path)
    again = records.load_labeled(spark, path)
    new = again.where("instance_id = 'a'").withColumn("category", F.lit("api_misuse"))
    assert {r["instance_id"]: r["category"] for r in records.upsert(again, new).collect()} == {"a": "api_misuse", "b": "unlabeled"}


def test_audit_numbers(spark):
    rows = [("1", "null_type", "yes", "nullability"), ("2", "null_type", "partial", "nullability"), ("3", "incomplete_edit", "yes", "change_consistency"),
            ("4", "wrong_logic", "no", "none"), ("5", "misunderstood_intent", "no", "none")]
    df = spark.createDataFrame(rows, "instance_id string, category string, would_catch string, which_property string")
    s = ex.audit_signals(df).first()
    assert (s["n_analyzable"], s["analyzable_rate"], s["recommended_property"], s["kill_signal"], s["redirect_signal"]) == (3, 0.6, "nullability", False, False)


def test_agent_collection(spark):
    rows = [("solved", True, {"a": True}, {"p": True}), ("broke", True, {"a": True}, {"p": False}), ("failed", False, {"a": False}, {"p": True}),
            ("partly", False, {"a": False, "b": True}, {}), ("empty", False, {}, {}), ("seen", False, {"a": False}, {})]
    df = spark.createDataFrame(rows, "instance_id string, resolved boolean, fail_to_pass map<string,boolean>, pass_to_pass map<string,boolean>")
    skip = spark.createDataFrame([("seen",)], "instance_id string")
    got = {r["instance_id"]: r for r in records.collect_agent(df, skip).collect()}
    assert {k: r["patch_source"] for k, r in got.items()} == {"broke": "agent_regressed", "failed": "agent_failed", "partly": "agent_partial", "empty": "agent_failed"}
    assert got["broke"]["test_results"] == {"a": "PASSED", "p": "FAILED"}


def test_reports_and_runs(spark, tmp_path):
    tests = {"FAIL_TO_PASS": {"success": ["a"], "failure": []}, "PASS_TO_PASS": {"success": [], "failure": ["b", "c"]}}
    for name, text in {"i1": json.dumps({"i1": {"resolved": True, "tests_status": tests}}), "i2": json.dumps({"other": {"resolved": False}}), "i3": "{broken"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(text)
    got = {r["instance_id"]: r for r in records.load_reports(spark, str(tmp_path)).collect()}
    assert (got["i1"]["resolved"], got["i1"]["ftp_pass"], got["i1"]["ptp_fail"], got["i1"]["error"]) == (True, 1, 2, "")
    assert got["i2"]["resolved"] is False and got["i2"]["error"] == "" and got["i3"]["error"] == "report.json was not valid JSON"
    files = spark.createDataFrame([("g", "r1", 1), ("g", "r2", 5), ("a", "r1", 2)], "arm string, run_id string, modified int")
    assert {r["arm"]: r["run_id"] for r in records.latest_run(files).collect()} == {"g": "r2", "a": "r1"}
    manifest = spark.createDataFrame([("g", "r1")], "arm string, run_id string")
    assert {r["arm"]: r["run_id"] for r in records.latest_run(files, manifest).collect()} == {"g": "r1", "a": "r1"}


def test_pairs_and_recomputed_scores(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"instance_id": "x", "oracle": {"success": True, "patch_coverage_score": 0.1}, "ablation": {"success": True}}))
    pairs = records.load_pairs(spark, str(tmp_path))
    assert pairs.first()["legacy"] is True
    fb = spark.createDataFrame([("x", "+new_value = 1\n-old_value = 2\n", "nullability", "high")], "instance_id string, gold_patch string, which_property string, confidence string")
    out = spark.createDataFrame([("x", "g", "new_value = 1")], "instance_id string, arm string, text string")
    better = records.recompute_coverage(pairs, out, fb, patches.patch_coverage)
    lift = {r["property"]: r for r in ex.coverage_lift(better, fb).collect()}
    assert lift["nullability"]["guided_coverage"] == 1.0 and lift[None]["coverage_delta"] == 1.0 and lift[None]["guided_wins"] == 1


def test_selection(spark):
    df = spark.createDataFrame([("b", "org/x", '["t"]'), ("a", "org/x", None), ("c", "org/y", "[]")], "instance_id string, repo string, l string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string")
    assert [r["instance_id"] for r in records.select_instances(df, ids, "org/x", 1).collect()] == ["a"]
    assert [r["v"] for r in df.orderBy("instance_id").select(records.string_list("l").alias("v")).collect()] == [[], ["t"], []]
    first = [r["instance_id"] for r in records.seeded_order(df, "instance_id", 42).collect()]
    assert first == [r["instance_id"] for r in records.seeded_order(df.repartition(3), "instance_id", 42).collect()]


PATCH = """--- a/src/m.py
+++ b/src/m.py
@@ -3,2 +3,3 @@
-    return value.strip()
+    if value is None:
+        return None
+    return value.strip()
@@ -40 +41 @@ def later():
-    pass
+    # only a comment here
--- a/gone.py
+++ /dev/null
--- a/readme.md
+++ b/readme.md
"""


def test_patches(spark):
    df = spark.createDataFrame([(PATCH, "x\n    if value is None:\n        return None\n")], "p string, o string")
    r = df.select(patches.modified_files("p").alias("f"), patches.significant_lines("p", "+").alias("a"), patches.significant_lines("p", "-").alias("d"),
                  patches.patch_coverage("p", "o").alias("c"), patches.hunk_ranges("p").alias("h")).first()
    assert r["f"] == ["src/m.py"] and r["a"] == ["if value is None:", "return None", "return value.strip()"] and r["d"] == ["return value.strip()"]
    assert r["c"] == 0.75 and [tuple(x) for x in r["h"]] == [(3, 4), (40, 40)]


def brute_truncate(content, hunks, limit):
    lines = content.split("\n")
    if len(lines) <= limit:
        return content
    if not hunks:
        return "\n".join(lines[:limit])

    def shown(c):
        return {n for s, e in hunks for n in range(max(1, s - c), min(len(lines), e + c) + 1)}
    c = max(5, limit // (2 * len(hunks)))
    while len(shown(c)) > limit and c > 1:
        c = max(1, c // 2)
    keep, out, n = shown(c), [], 1
    while n <= len(lines):
        m = n
        while m <= len(lines) and (m in keep) == (n in keep):
            m += 1
        out.append("\n".join(lines[n - 1:m - 1]) if n in keep else f"# ... (lines {n}–{m - 1} omitted) ...")
        n = m
    return "\n".join(out)


def test_truncation_against_brute_force(spark):
    cases = []
    for n in (5, 30, 90, 200):
        for hunks in ([], [(3, 4)], [(10, 12), (60, 61)], [(2, 2), (20, 25), (80, 85), (86, 86)]):
            hunks = [h for h in hunks if h[1] <= n]
            content = "\n".join(f"line {i}" for i in range(1, n + 1))
            patch = "\n".join(f"@@ -{s},{e - s + 1} +1,1 @@" for s, e in hunks)
            cases.append((content, patch, brute_truncate(content, hunks, 20)))
    df = spark.createDataFrame(cases, "c string, p string, want string")
    for r in df.select("want", patches.truncate_to_relevant("c", "p", 20).alias("got")).collect():
        assert r["got"] == r["want"]


def test_text_functions(spark):
    df = spark.createDataFrame([("äx\nfoo = xfoo\nfoo", "foo", "a```\nq```b", 6)], "s string, y string, b string, o int")
    r = df.select(patches.symbol_position("s", "y").alias("p"), patches.byte_to_line("s", "o").alias("l"), patches.code_block("b").alias("k"),
                  patches.head_lines("s", 2).alias("h"), patches.percent(F.lit(0.1234)).alias("c"), patches.percent(F.lit(float("nan"))).alias("n")).first()
    assert r["p"] == 4 and r["l"] == 2 and r["k"] == "q" and r["h"] == "äx\nfoo = xfoo\n… (truncated)" and (r["c"], r["n"]) == ("12.3%", "N/A")


CORPUS = [
    ("01", "local", {"m.py": "def f():\n    r = None\n    return r.x\n"}, "def f():\n    r = 1\n    return r.x\n", [("r", "attribute")], False),
    ("02", "two files", {"m.py": "from d import load\n\ndef f():\n    q = load()\n    return q['k']\n", "d.py": "def load():\n    return None\n"},
     "from d import load\n\ndef f():\n    q = load()\n    if q is None:\n        return 0\n    return q['k']\n", [("q", "subscript")], False),
    ("03", "several", {"m.py": "def f(n=None):\n    n.a\n    n.b\n"}, "def f(n=None):\n    assert n is not None\n    n.a\n    n.b\n", [("n", "attribute")] * 2, True),
]


def test_golden_corpus(spark, tmp_path):
    for id_, name, files, fixed, expected, dedup in CORPUS:
        (tmp_path / f"{id_}.json").write_text(json.dumps({
            "id": id_, "name": name, "files": [{"role": "buggy", "path": f"{id_}/{p}"} for p in files], "primary_file": f"{id_}/m.py",
            "fixed_files": [{"role": "fixed", "path": f"{id_}/fixed.py"}], "expect_dedup": dedup,
            "expected_regressions": [{"func": "f", "symbol": s, "kind": k} for s, k in expected]}))
    texts = [(f"{id_}/{p}", t) for id_, _, files, *_ in CORPUS for p, t in files.items()] + [(f"{id_}/fixed.py", fixed) for id_, _, _, fixed, *_ in CORPUS]
    for p, t in texts:      # as files, read back under the names that the specs use
        (tmp_path / "texts" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "texts" / p).write_text(t)
    folder = str(tmp_path / "texts")
    found = records.relative_to(records.load_texts(spark, folder), folder)
    assert {(r["path"], r["text"]) for r in found.collect()} == set(texts)
    cases = corpus.evaluate(records.load_specs(spark, str(tmp_path / "*.json")), found).cache()
    assert all(r["catch_ok"] and r["fp_ok"] and r["concrete"] == r["witnesses"] and r["error"] == "" for r in cases.collect())
    gate = ex.corpus_gate(cases).first()
    assert (gate["caught"], gate["expected"], gate["passed"]) == (4, 4, None)      # nobody measured the latency
    timed = ex.corpus_gate(cases.withColumn("latency_ms", F.lit(12.0))).first()
    assert timed["passed"] is True and ex.corpus_gate(cases.withColumn("latency_ms", F.lit(2500.0))).first()["passed"] is False
    short = corpus.evaluate(records.load_specs(spark, str(tmp_path / "*.json")), found.where("path != '02/d.py'"))
    assert {r["id"]: r["error"] for r in short.collect()} == {"01": "", "02": "no text for 02/d.py", "03": ""}


def test_sweep(spark):
    src = spark.createDataFrame([("i", "a.py", "def f(x=None):\n    x.a\n"), ("j", "b.py", "def f(x):\n    x.a\n"), ("k", "c.py", None)], "instance_id string, uri string, text string")
    s = ex.sweep_summary(corpus.sweep(src)).first()
    assert (s["n_total"], s["n_fetched"], s["n_fired"], s["n_errors"], s["n_high"], s["fp_rate"], s["band"]) == (3, 2, 1, 1, 1, 0.5, "bad")


def test_python_tree(spark, tmp_path):
    for p in ("a.py", "pkg/b.py", "node_modules/c.py", ".git/d.py", "pkg/__pycache__/e.py", "pkg/f.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    df = read_python_tree(spark, str(tmp_path))
    assert sorted(r["uri"].rsplit("/", 1)[1] for r in df.collect()) == ["a.py", "b.py"]
    (tmp_path / ".git" / "old.py").write_bytes("s = 'é'\nx.a\n".encode("latin-1"))
    (row,) = read_python_tree(spark, f"file://{tmp_path}/.git/").where("uri like '%old.py'").collect()     # below a hidden folder
    assert row["text"] == "s = '\ufffd'\nx.a\n" and row["valid"] is False


def test_missing_paths(spark, tmp_path):
    assert records.load_labeled(spark, str(tmp_path / "none")).count() == 0
    for read in (records.load_feedback, records.load_pairs, records.load_sessions, records.load_specs):
        with pytest.raises(AnalysisException):
            read(spark, str(tmp_path / "none"))


def test_patch_of_many_lines(spark):
    patch = "\n".join(f"--- a/f{i}.py\n+++ b/f{i}.py" for i in range(2000))
    t = time.perf_counter()
    (row,) = spark.createDataFrame([(patch,)], "p string").select(patches.modified_files("p").alias("f")).collect()
    assert row["f"] == [f"f{i}.py" for i in range(2000)] and time.perf_counter() - t < 10


def test_undefined_rates_stay_null(spark):
    empty = spark.createDataFrame([], "fetched boolean, fired boolean, error string, confidences array<string>")
    assert ex.sweep_summary(empty).first()["fp_rate"] is None and not math.isnan(0.0)
