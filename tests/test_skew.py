"""Hot keys: segmented scans, rankings and lookups equal brute force."""

import random

from pyspark.sql import functions as F

from deflow.operators.prefix import Order, segment_width
from deflow.operators.reaching import reaching_defs, value_flow
from deflow.operators.skew import hot_keys, lookup, rank_in_group


def stream(seed=7, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        func = 0 if rnd.random() < 0.4 else rnd.randrange(1, 9)
        rows.append((func, i * 3 + rnd.randrange(3), i, rnd.choice(["def", "def", "use", "use", "use", "unknown"]) if rnd.random() < 0.9 else "use", rnd.randrange(3)))
    return rows


def brute(rows):
    out, last, epoch = set(), {}, {}
    for func, ts, node, tag, sym in sorted(rows, key=lambda r: (r[1], r[2])):
        if tag == "unknown":
            epoch[func] = epoch.get(func, 0) + 1
            last = {k: v for k, v in last.items() if k[0] != func}
        elif tag == "def":
            last[func, sym] = node
        elif (func, sym) in last:
            out.add((func, sym, last[func, sym], node, "Unknown" if epoch.get(func) else "Definite"))
    return out


def test_reaching_definitions_segmented(spark):
    rows = stream()
    df = spark.createDataFrame(rows, "func int, ts long, node int, tag string, symbol int")
    order = Order(F.col("ts"), ["ts", "node"])
    width = segment_width(df, ["func"], F.col("ts"), target_rows=100)
    assert width is not None and width < 2000
    assert segment_width(df, ["func"], F.col("ts")) > 2000     # one segment, by the same plan
    for w in (segment_width(df, ["func"], F.col("ts")), width, 50):
        got = {tuple(r) for r in reaching_defs(df, ["func"], order, F.col("node"), w).collect()}
        assert got == brute(rows)


def test_value_flow_is_containment(spark):
    rnd = random.Random(3)
    span = lambda: (lambda s: (s, s + rnd.randrange(1, 300)))(rnd.randrange(1000))
    edges = [("f", span(), span()) for _ in range(200)]
    df = spark.createDataFrame(edges, "file string, def_node struct<start_byte:int,end_byte:int>, use_node struct<start_byte:int,end_byte:int>")
    pos = spark.createDataFrame([("f", p) for p in range(0, 1300, 37)], "file string, position int")
    inside = lambda n, p: n[0] <= p < n[1]
    for direction in ("backward", "forward", "both"):
        want = set()
        for p in range(0, 1300, 37):
            for _, d, u in edges:
                if direction != "forward" and inside(u, p):
                    want.add(("f", p, *d))
                if direction != "backward" and inside(d, p):
                    want.add(("f", p, *u))
        assert {tuple(r) for r in value_flow(df, pos, ["file"], direction).collect()} == want


def test_rank_in_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else "k%d" % rnd.randrange(4), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {tuple(r) for r in rank_in_group(df, ["k"], ["v"], F.floor(F.col("v") / 100), "rn").collect()}
    seen, want = {}, set()
    for k, v in rows:
        seen[k] = seen.get(k, 0) + 1
        want.add((k, v, seen[k]))
    assert got == want


def test_lookup_with_hot_keys(spark):
    rows = [("hot", i) for i in range(500)] + [("c%d" % (i % 100), i) for i in range(500)] + [("miss", 1)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1)] + [("c%d" % i, i) for i in range(100)], "k string, w int")
    assert hot_keys(left, ["k"]) == [("hot",)] and hot_keys(left.limit(0), ["k"]) == []
    nulls = left.unionByName(spark.createDataFrame([(None, i) for i in range(900)], left.schema))
    assert hot_keys(nulls, ["k"]) == [("hot",)]
    for how, hot in (("inner", [("hot",)]), ("left", [("hot",)]), ("left", [])):
        got = sorted(map(tuple, lookup(left, right, ["k"], how, hot).collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
