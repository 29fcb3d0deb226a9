"""Domains: laws of their joins, and both through one fold."""

import itertools

import pytest
from pyspark.sql import functions as F

from deflow.functions.lattice import DOMAINS, MAYBE_NONE, NULLNESS, Domain
from deflow.operators.facts import tapes
from deflow.operators.solver import place, solve
from deflow.sources.code import parse_sources
from deflow.sources.syntax import read_functions

PROGRAM = """def g(q):
    if q:
        return None
    return 1

def f(c, a=None):
    if c:
        a = 1
    a.one
    b = g(c)
    b.two
    a = 2
    a.three
"""


@pytest.mark.parametrize("domain", DOMAINS, ids=lambda d: d.name)
def test_laws(spark, domain: Domain):
    codes = range(len(domain.join))
    j = lambda a, b: domain.join[a][b]
    for a, b, c in itertools.product(codes, repeat=3):
        assert j(a, a) == a and j(a, b) == j(b, a) and j(j(a, b), c) == j(a, j(b, c))
        assert j(a, b) != a or j(j(a, c), j(b, c)) == j(a, c)      # what lies below stays below
    pairs = spark.createDataFrame(list(itertools.product(codes, repeat=2)), "x tinyint, y tinyint")
    assert all(r["j"] == domain.join[r["x"]][r["y"]] for r in pairs.select("*", F.expr(domain.join_sql("x", "y")).alias("j")).collect())


def test_two_domains_one_fold(spark):
    parsed = parse_sources(spark.createDataFrame([("w", "m", PROGRAM)], "ws string, uri string, text string"))
    found = {}
    for d in (NULLNESS, MAYBE_NONE):
        solved = solve(place(tapes(parsed), d), domain=d)
        found[d.name] = {PROGRAM.encode()[r["start_byte"]:r["end_byte"]].decode() for r in solved.regressions.collect()}
    assert found == {"definite": set(), "possible": {"a.one", "b.two"}}


def test_transfer(spark):
    """A domain that swaps the tape's two known values reports what is proven not to be None."""
    swapped = Domain("sure", NULLNESS.join, (0, 1, 3, 2), 3)
    parsed = parse_sources(spark.createDataFrame([("w", "m", PROGRAM)], "ws string, uri string, text string"))
    solved = solve(place(tapes(parsed), swapped), domain=swapped)
    assert {PROGRAM.encode()[r["start_byte"]:r["end_byte"]].decode() for r in solved.regressions.collect()} == {"a.three"}


# ---- recovery, on the reader itself

def shown(text):
    raw = text.encode()
    functions, errors = read_functions(text)
    nodes = {f["name"]: [(n[0], raw[n[3]:n[4]].decode()) for n in f["nodes"] if n[0] in ("ERROR", "attribute") or n[0].endswith("_statement") and n[0] != "expression_statement"] for f in functions}
    return nodes, [raw[a:b].decode() for a, b in errors]


@pytest.mark.parametrize("body, want", [
    ("    if x:\n        z z\n        x.b\n", [("if_statement", "if x:\n        z z\n        x.b"), ("ERROR", "z z"), ("attribute", "x.b")]),
    ("    x.a; z z; x.b\n", [("attribute", "x.a"), ("ERROR", "z z"), ("attribute", "x.b")]),
    ("    print 'a'\n    x.b\n", [("print_statement", "print 'a'"), ("attribute", "x.b")]),
    ("    d(k=1, x.b)\n", [("attribute", "x.b")]),
    ("    d(k=x == 1, None)\n", [("ERROR", "d(k=x == 1, None)")]),
    ("    if z z:\n        x.b\n", [("ERROR", "if z z:\n        x.b")]),
    ("    try:\n        z z\n    except E:\n        pass\n", [("try_statement", "try:\n        z z\n    except E:\n        pass")]),
    ("    if x:\n        x.a\n    elif z z:\n        pass\n    # end\n", [("if_statement", "if x:\n        x.a"), ("attribute", "x.a"), ("ERROR", "elif z z:\n        pass\n    # end")]),
    ("    while x: z z\n    else: x.b\n", [("while_statement", "while x: z z\n    else: x.b"), ("ERROR", "z z")]),
    ("    y = {'a:b': \"é;\", 'c': lambda: 1}; z z\n", [("ERROR", "z z")]),
    ("    if x:\n        if x:\n            for i in x:\n                z z\n                i.a\n            x.b\n    x.c\n",
     [("if_statement", "if x:\n        if x:\n            for i in x:\n                z z\n                i.a\n            x.b"),
      ("if_statement", "if x:\n            for i in x:\n                z z\n                i.a\n            x.b"),
      ("for_statement", "for i in x:\n                z z\n                i.a"), ("ERROR", "z z"), ("attribute", "i.a"), ("attribute", "x.b"), ("attribute", "x.c")]),
])
def test_recovery(body, want):
    after = "\ndef g(y):\n    y.z\n"
    assert shown(f"def f(x=None):\n{body}{after}") == ({"f": want, "g": [("attribute", "y.z")]}, [])
    assert shown(f"def f(x=None): {body.strip()}\n")[0].keys() == {"f"} if "\n" not in body.strip() else True


def test_recovery_of_deep_and_odd_text():
    deep = "def f(x):\n" + "".join(" " * (i + 1) + "if x:\n" for i in range(90)) + " " * 91 + "z z\n"
    assert [k for k, _ in shown(deep)[0]["f"]].count("ERROR") == 1
    for odd in ("def f(x):\n    (\n", "def f(x):\n    if x:\n", "def f(x):\n\tz z\n        y y\n", "def f(x):\n    'a\n    x.b\n", "def f(:\n    x\n", "def f(x): print\n  z z"):
        shown(odd)
