"""The versioned record store, feedback instances and matches by several ways."""

import json
import random

import pytest
from pyspark.sql import functions as F

from deflow.operators.matching import fallback_match, normalised
from deflow.sources import records
from deflow.sources.store import Conflict, RecordStore

SCHEMA = "instance_id string, n long, tags map<string,string>"


def state(df):
    return {r["instance_id"]: r["n"] for r in df.collect()}


def test_random_writes(spark, tmp_path):
    """Every version is what a dictionary says, also after later ones were made."""
    store = RecordStore(spark, str(tmp_path / "s"), parts=4)
    assert store.read() is None and store.versions() == [] and store.remove(spark.createDataFrame([], SCHEMA)) is None
    rng, now, past = random.Random(5), {}, {}
    for i in range(12):
        rows = [(rng.choice([None, *"abcdefgh"]), rng.randrange(100), {"k": "v"}) for _ in range(rng.randrange(6))]
        df = spark.createDataFrame(rows, SCHEMA)
        how = rng.choice(["merge", "merge", "replace", "remove"])
        best = {k: max(n for j, n, _ in rows if j == k) for k, _, _ in rows}
        if how == "remove":
            made = store.remove(df)
            now = {k: n for k, n in now.items() if k not in best}
        else:
            made = getattr(store, how)(df, order=F.col("n"))
            now = {**(now if how == "merge" else {}), **best}
        if made:
            past[made.number] = dict(now)
    assert store.versions() == sorted(past)
    assert all(state(store.read(n)) == want for n, want in past.items())
    store.forget(2)
    assert store.versions() == sorted(past)[-2:]
    assert all(state(store.read(n)) == past[n] for n in store.versions())


def test_merge_leaves_other_parts(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), parts=16)
    one = store.replace(spark.range(200).selectExpr("cast(id AS string) AS instance_id", "id AS n"))
    two = store.merge(spark.createDataFrame([("7", -7)], "instance_id string, n long"))
    assert len(one.parts) == 16 and sum(one.parts[p] != two.parts[p] for p in one.parts) == 1
    assert state(store.read())["7"] == -7 and store.read().count() == 200
    three = store.merge(spark.createDataFrame([("7",)], "instance_id string"))
    assert state(store.read())["7"] is None and three.number == 3
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([("7", 1)], "instance_id string, other int"))


def test_stopped_write_and_two_writers(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), parts=4)
    store.replace(spark.createDataFrame([("a", 1)], "instance_id string, n long"))
    bad = spark.createDataFrame([("b", 2)], "instance_id string, n long").withColumn("n", F.expr("raise_error('stopped')").cast("long"))
    with pytest.raises(Exception, match="stopped"):
        store.replace(bad)
    assert state(store.read()) == {"a": 1} and store.versions() == [1]
    seen = store.version()
    more = spark.createDataFrame([("c", 3)], "instance_id string, n long")
    store.merge(more, base=seen)
    with pytest.raises(Conflict):
        store.merge(more.withColumn("n", F.lit(4).cast("long")), base=seen)
    assert state(store.read()) == {"a": 1, "c": 3}
    assert state(RecordStore(spark, store.path, parts=9).merge(more, base=store.version()) and store.read()) == {"a": 1, "c": 3}


def test_key_and_part_names(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), key="Part", parts=3)
    store.replace(spark.createDataFrame([("x", 1), ("y", 2)], "Part string, n int"))
    store.merge(spark.createDataFrame([("y", 5)], "Part string, n int"))
    assert sorted(map(tuple, store.read().collect())) == [("x", 1), ("y", 5)]


def test_labeled_on_one_path(spark, tmp_path):
    path = str(tmp_path / "set")
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "old.jsonl").write_text("\n".join(json.dumps({"instance_id": i, "patch": "p" + i}) for i in "ab"))
    new = spark.createDataFrame([("b", "other"), ("c", "other")], "instance_id string, category string")
    records.merge_labeled(new, path)
    got = {r["instance_id"]: (r["category"], r["patch"]) for r in records.load_labeled(spark, path).collect()}
    assert got == {"a": ("unlabeled", "pa"), "b": ("other", ""), "c": ("other", "")}
    reader = records.load_labeled(spark, path)
    records.save_labeled(records.load_labeled(spark, path).where("instance_id <> 'a'"), path)
    assert {r[0] for r in records.load_labeled(spark, path).select("instance_id").collect()} == {"b", "c"}
    assert {r[0] for r in reader.select("instance_id").collect()} == {"a", "b", "c"}
    assert records.load_labeled(spark, path, 1).count() == 2
    feedback = spark.createDataFrame([("b",), ("z",)], "instance_id string")
    got = {r["instance_id"]: r for r in records.feedback_instances(feedback, records.load_labeled(spark, path)).collect()}
    assert set(got) == {"b", "z"} and got["z"]["repo"] == "" and got["z"]["fail_to_pass"] == []
    only = records.feedback_instances(feedback, records.load_labeled(spark, path), spark.createDataFrame([("z",)], "instance_id string"))
    assert [r["instance_id"] for r in only.collect()] == ["z"]


def test_fallback(spark):
    left = spark.createDataFrame([(1, "p", "Some  text"), (2, "q", "some text\n"), (3, None, "SOME TEXT"), (4, "", ""), (5, None, None)], "k int, path string, text string")
    right = spark.createDataFrame([(10, 1, "z", "no"), (11, None, "q", "x"), (12, None, "q", "x"), (13, None, None, "some text"), (14, None, "", "")], "log int, id int, path string, text string")
    ways = [(F.col("k"), F.col("id")), (F.col("path"), F.col("path")), (normalised("text"), normalised("text"))]
    got = {r["k"]: (r["matched"], r["way"]) for r in fallback_match(left, right, ways, "k", "log", "log").collect()}
    assert got == {1: (10, 1), 2: (12, 2), 3: (13, 3), 4: (None, None), 5: (None, None)}
