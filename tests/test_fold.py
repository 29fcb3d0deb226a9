"""The fold's environment is rewritten element by element while short and from pieces beyond; parameters whose value is decided share a context."""

from deflow.operators import fold
from deflow.operators.facts import tapes
from deflow.operators.solver import alone
from deflow.sources.code import parse_sources

NAMES = [f"v{i}" for i in range(60)]
WIDE = "def f(a, b=None, c=None, *, d: int = 3):\n" + "".join(f"    {n} = {'a' if i % 3 else 'None'}\n" for i, n in enumerate(NAMES)) + (
    "    if v3:\n        v3.x\n        v4 = None\n    else:\n        v4 = None\n    v4.y\n    while b:\n        c.z\n        v5 = b\n    for v6 in v7:\n        v6.q\n    b.w\n    z z\n    a.t\n    return v4\n")


def test_short_and_wide_environments_agree(spark, monkeypatch):
    files = spark.createDataFrame([("ws", "wide.py", WIDE), ("ws", "small.py", "def g(a, b=None):\n    v = a\n    if v is None:\n        v.x\n    b.y\n    return v\n")], "ws string, uri string, text string")
    functions = tapes(parse_sources(files)).cache()
    found = []
    for short in (0, 32, 10_000):
        monkeypatch.setattr(fold, "SHORT", short)
        found.append(sorted(map(repr, alone(functions).select("uri", "ctxs").collect())))
    assert found[0] == found[1] == found[2]
    small = next(r for r in alone(functions).collect() if r["uri"] == "small.py")["ctxs"]
    assert [x["ret"] for x in small] == [1, 1, 1] and small[2] == small[0] and len(small[1]["hits"]) == 2
    functions.unpersist()
