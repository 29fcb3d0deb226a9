"""The Jaccard join against comparing all pairs."""

import random

import numpy as np
import pytest

from deflow.llm import queries, setjoin
from deflow.llm.components import components
from tests.llm.conftest import ROWS


def plain(rows):
    """doc_id, set size, component of each row, by comparing every pair."""
    def elements(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(k, elements(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, s) in enumerate(sets):
        for j in range(i):
            t = sets[j][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(sets[i][0])
    low = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted([(k, len(s), low[find(i)] if s else k) for i, (k, s) in enumerate(sets)], key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([tuple(r) for r in setjoin.join(df, **kw).collect()], key=repr)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    assert run(spark, rows) == plain(rows)


def test_chains_and_hot_elements(spark, monkeypatch):
    """Drifting copies whose ends are not alike, short texts around a shared passage, and a hot element in every packing."""
    rng = random.Random(3)
    w = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(w)
        w[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, f"a{i} b{i} c{i} d{i} {passage}" + f" e{i}" * (i % 9)) for i in range(60)]
    monkeypatch.setattr(setjoin, "LOCAL_HOT", 3)
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, " ")], [(2, "a b"), (1, "A b"), (3, "a b c")]])
def test_small(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_query(spark, tiny):
    got = sorted([tuple(r) for r in queries.op5_jaccard_join(spark, tiny).collect()], key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert got == plain(rows)


def test_keep_first_keeps_columns(spark, docs):
    wide = docs.where("doc_id IS NOT NULL").withColumn("component_id", docs["n_chars"]).withColumn("_lost", docs["n_chars"])
    kept = setjoin.keep_first(wide)
    assert kept.columns == wide.columns
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    low = {(k, c) for k, _, c in plain(rows)}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, c in low if k == c}


def test_keep_first_keeps_one_row_of_each_component(spark):
    """Null, repeated and clashing keys: every component has one row left, and texts without words all stay."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a, "y"), (None, a, "x"), (None, a + " more", "x"),          # null keys beside a key
            (2, b, "y"), (2, b, "x"), (2, b + " more", "x"),                # rows that repeat the naming key
            (1, c, "x"),                                                    # a key of another component, no other copy
            (None, d, "y"), (None, d, "x"), (None, d, None),                # null keys alone
            (3, "", "x"), (3, "", "x"), (None, None, "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = [tuple(r) for r in setjoin.keep_first(df).collect()]
    words = [r for r in kept if r[1]]
    assert sorted(r for r in words if r[0] is not None and not r[1].startswith("b")) == [(1, a, "y"), (1, c, "x")]
    assert [r for r in words if r[0] is None] == [(None, d, None)]
    assert len([r for r in words if r[1].startswith("b")]) == 1
    assert len(words) == 4 and len(kept) == 8


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 63, 100).astype(np.uint64), rng.integers(0, 9, 7).astype("<u2"), np.zeros(0, "<u4")]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, setjoin.unpack(setjoin.pack(*arrays))))


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)]])
def test_components(spark, links):
    root = {}
    for a, b in links:
        group = {x for x in root if root[x] in (root.get(a, a), root.get(b, b))} | {a, b}
        root.update(dict.fromkeys(group, min(group)))
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, r) for x, r in root.items() if any(x in l and l[0] != l[1] for l in links)}
