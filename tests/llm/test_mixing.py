"""Mixing with very many sources, and with blocks that are cut again."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from deflow.llm import mixing


def held_to_plain(rows, near):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken, most = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        assert r["taken"] == r["size"] * len(r["draws"]) <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[n] - goal[n]) <= near(most[n]) for n in names)
    return names


def test_many_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 9)), None if i % 97 == 0 else f"s{rng.randrange(2500)}é" if i % 3 else "hot") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shards=7).collect()
    names = held_to_plain(got, lambda most: most / 2)
    assert len(got) == len(rows) and len(names) > 1500
    # The tree deals each (source, draw) to one shard, equal numbers to all, each source in disjoint ranges.
    shard = {}
    for r in got:
        for d, s in zip(r["draws"], r["shards"]):
            assert shard.setdefault((r["source"], d), s) == s
    assert set(r["source"] for r in got) == set(names) and set(shard.values()) <= set(range(7))
    last = {}
    for (source, d), s in sorted(shard.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        assert last.get(source, 0) <= s
        last[source] = s
    again = mixing.mix(docs.repartition(3), shards=7).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_blocks_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_BITS", 3)
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 16)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), "ab"[i % 2] if i % 50 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held_to_plain(mixing.mix(docs, shards=3).collect(), lambda most: most)
    nothing = mixing.mix(docs.withColumn("text", F.lit(None).cast("string")), shards=3).collect()
    assert len(nothing) == 4000 and all(r["target"] == 0 and not r["draws"] for r in nothing)


def test_draw_between_groups():
    assert mixing._first([1], 0, 5, 3) == 0 and mixing._first([1], 5, 0, 3) == 3 and mixing._first([1], 4, 6, 10) == 4
    for even, odd, want in ((10 ** 10, 3, 5 * 10 ** 9), (7, 10 ** 11, 10 ** 11 + 3), (10 ** 12, 10 ** 12, 10 ** 12 + 1)):
        got = mixing._first([2], even, odd, want)
        assert max(0, want - odd) <= got <= min(even, want) and abs(got - want * even / (even + odd)) < 2
    many = [mixing._first([i], 300, 700, 100) for i in range(400)]
    assert abs(np.mean(many) - 30) < 1 and 2 < np.std(many) < 7


def test_tree_of_many_sources():
    rng = np.random.default_rng(5)
    tree = mixing.SplittingTree(tuple(rng.integers(0, 9, 300).tolist()), 5, 1)
    source = np.repeat(np.arange(300), tree.counts)
    draw = np.concatenate([np.arange(c) for c in tree.counts])
    shard = tree.shard_of(source, draw, {})
    total = sum(tree.counts)
    assert set(np.bincount(shard, minlength=5)) <= {total // 5, total // 5 + 1}
    assert np.array_equal(shard[::3], tree.shard_of(source[::3], draw[::3], {}))
