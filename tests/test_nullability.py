"""Small programs and the dereferences that must be reported, all solved in one analysis."""

import pytest
from pyspark.sql import functions as F

from deflow.operators.facts import null_facts, tapes
from deflow.operators.solver import intraprocedural, place, solve
from deflow.sources.code import file_unknowns, parse_sources

HEAD = "def f(x: Optional[str]):\n"
# name -> (files, expected set of (uri, symbol, kind, times))
CASES = {
    "none then attribute": ({"a": "def f():\n    x = None\n    return x.upper()\n"}, {("a", "x", "attribute", 1)}),
    "none then subscript": ({"a": "def f():\n    x = None\n    return x[0]\n"}, {("a", "x", "subscript", 1)}),
    "none then call": ({"a": "def f():\n    x = None\n    x()\n"}, {("a", "x", "call", 1)}),
    "reassigned": ({"a": "def f():\n    x = None\n    x = 'a'\n    return x.upper()\n"}, set()),
    "copy": ({"a": "def f():\n    x = None\n    y = x\n    y.a\n"}, {("a", "y", "attribute", 1)}),
    "default none": ({"a": "def f(x=None):\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "default five": ({"a": "def f(x=5):\n    x.a\n"}, set()),
    "typed default none": ({"a": "def f(x: str = None):\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "local annotation wins": ({"a": "def f():\n    x: str = None\n    x.a\n"}, set()),
    "local optional": ({"a": "def f():\n    x: Optional[str] = g()\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "star arguments": ({"a": "def f(*args, **kw):\n    args.a\n    kw.b\n"}, set()),
    "chain reports innermost": ({"a": HEAD + "    x.a.b.c\n"}, {("a", "x", "attribute", 1)}),
    "three dereferences": ({"a": "def f():\n    x = None\n    x.a\n    x.b\n    x.c\n"}, {("a", "x", "attribute", 3)}),
    "parenthesised is no consumer": ({"a": HEAD + "    (x).a\n"}, set()),
    "parenthesised none is unknown": ({"a": "def f():\n    x = (None)\n    x.a\n"}, set()),
    "chained assignment": ({"a": "def f():\n    a = b = None\n    a.x\n    b.x\n"}, set()),
    "augmented": ({"a": "def f():\n    x = None\n    x += 1\n    x.a\n"}, set()),
    "unpacking": ({"a": "def f():\n    x = None\n    x, y = 1, 2\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "statement tuple shows first": ({"a": "def f():\n    x = None\n    x.a, x.b\n"}, {("a", "x", "attribute", 1)}),
    "f-string skipped": ({"a": "def f():\n    x = None\n    y = f'{x.a}'\n"}, set()),
    "lambda visited": ({"a": "def f():\n    x = None\n    g(lambda: x.a)\n"}, {("a", "x", "attribute", 1)}),
    "attribute target": ({"a": "def f():\n    x = None\n    x.a = 1\n"}, {("a", "x", "attribute", 1)}),
    # narrowing
    "guard is none": ({"a": HEAD + "    if x is None:\n        pass\n    else:\n        x.a\n"}, set()),
    "guard is none inside": ({"a": HEAD + "    if x is None:\n        x.a\n"}, {("a", "x", "attribute", 1)}),
    "guard is not none": ({"a": HEAD + "    if x is not None:\n        x.a\n"}, set()),
    "guard equals": ({"a": HEAD + "    if None != x:\n        x.a\n    else:\n        x.b\n"}, {("a", "x", "attribute", 1)}),
    "truthiness": ({"a": HEAD + "    if x:\n        x.a\n    else:\n        x.b\n"}, {("a", "x", "attribute", 1)}),
    "negation": ({"a": HEAD + "    if not x:\n        x.a\n    else:\n        x.b\n"}, set()),
    "parenthesised guard": ({"a": HEAD + "    if (x is not None):\n        x.a\n"}, set()),
    "opaque guard": ({"a": HEAD + "    if x and y:\n        x.a\n    x.b\n"}, set()),
    "unrelated guard": ({"a": HEAD + "    if y:\n        x.a\n"}, {("a", "x", "attribute", 1)}),
    "returns do not end paths": ({"a": HEAD + "    if x is None:\n        return 1\n    return x.a\n"}, set()),
    "elif chain": ({"a": HEAD + "    if y:\n        pass\n    elif x is None:\n        x.a\n    else:\n        x.b\n"}, {("a", "x", "attribute", 1)}),
    "assert": ({"a": HEAD + "    assert x is not None\n    x.a\n"}, set()),
    "assert message ignored": ({"a": HEAD + "    assert y, x.a\n"}, set()),
    "while": ({"a": HEAD + "    while x:\n        x.a\n    x.b\n"}, set()),
    "for iterable": ({"a": HEAD + "    for y in x:\n        x.a\n        y.b\n    x.c\n"}, set()),
    "loop body once": ({"a": "def f():\n    x = 1\n    for i in r():\n        x.a\n        x = None\n"}, set()),
    "both arms none": ({"a": "def f(c):\n    if c:\n        x = None\n    else:\n        x = None\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "arms disagree": ({"a": "def f(c):\n    if c:\n        x = None\n    else:\n        x = 1\n    x.a\n"}, set()),
    "one arm only": ({"a": "def f(c):\n    if c:\n        x = None\n    x.a\n"}, set()),
    "condition is read before": ({"a": HEAD + "    if x.a:\n        pass\n"}, {("a", "x", "attribute", 1)}),
    # barriers and broken text
    "try": ({"a": HEAD + "    try:\n        x.a\n    except E:\n        pass\n    x.b\n"}, set()),
    "with": ({"a": HEAD + "    with x.a:\n        pass\n    x.b\n"}, set()),
    "broken statement": ({"a": HEAD + "    z x\n    return x.a\n"}, set()),
    "broken neighbour": ({"a": "def g(d):\n    r = d +* [2\n    return r\n\ndef v():\n    return None\n\ndef f():\n    y = v()\n    return y.a\n"}, {("a", "y", "attribute", 1)}),
    "broken header": ({"a": "def g(:\n    pass\n\ndef f():\n    x = None\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    "decorated and nested": ({"a": "@d\ndef f():\n    x = None\n    x.a\n\nclass C:\n    def m(self):\n        y = None\n        y.a\n\ndef o():\n    def i():\n        z = None\n        z.a\n"}, set()),
    "not ascii": ({"a": "def f():\n    s = 'äöü'\n    x = None\n    x.a\n"}, {("a", "x", "attribute", 1)}),
    # calls
    "callee returns none": ({"a": "def g():\n    return None\n\ndef f():\n    v = g()\n    v.a\n"}, {("a", "v", "attribute", 1)}),
    "declared later": ({"a": "def f():\n    v = g()\n    v.a\n\ndef g():\n    return None\n"}, {("a", "v", "attribute", 1)}),
    "three hops": ({"a": "def f():\n    v = g()\n    v.a\n\ndef g():\n    return h()\n\ndef h():\n    return k()\n\ndef k():\n    return None\n"}, {("a", "v", "attribute", 1)}),
    "passes through": ({"a": "def p(x):\n    return x\n\ndef f():\n    r = p(None)\n    r.a\n"}, {("a", "r", "attribute", 1)}),
    "mixed returns": ({"a": "def g(c):\n    if c:\n        return None\n    return 1\n\ndef f():\n    v = g(1)\n    v.a\n"}, set()),
    "into callee": ({"a": "def f():\n    d(None)\n\ndef d(y):\n    y.a\n"}, {("a", "y", "attribute", 1)}),
    "into callee twice is one": ({"a": "def f():\n    d(None)\n    d(None)\n\ndef d(y):\n    y.a\n"}, {("a", "y", "attribute", 1)}),
    "into callee's callee": ({"a": "def f():\n    d(None)\n\ndef d(y):\n    e(1, y)\n\ndef e(a, b):\n    b.x\n"}, {("a", "b", "attribute", 1)}),
    "annotation beats caller": ({"a": "def f():\n    d(None)\n\ndef d(y: str):\n    y.a\n"}, set()),
    "keyword argument keeps its place": ({"a": "def f():\n    d(k=1, None)\n"}, set()),
    "surplus arguments": ({"a": "def f():\n    d(1, None)\n\ndef d(y):\n    y.a\n"}, set()),
    "annotated assignment skips call": ({"a": "def f():\n    z: str = d(None)\n\ndef d(y):\n    y.a\n"}, set()),
    "recursion": ({"a": "def f(x):\n    x.a\n    f(None)\n"}, {("a", "x", "attribute", 1)}),
    "mutual recursion": ({"a": "def f(x):\n    return g(x)\n\ndef g(x):\n    return f(x)\n\ndef h():\n    v = f(None)\n    v.a\n"}, set()),
    "last definition wins in file": ({"a": "def g():\n    return None\n\ndef g():\n    return 1\n\ndef f():\n    v = g()\n    v.a\n"}, set()),
    # files
    "cross file": ({"a": "from b import g\n\ndef f():\n    v = g()\n    v.a\n", "b": "def g():\n    return None\n"}, {("a", "v", "attribute", 1)}),
    "cross file qualified": ({"a": "import b\n\ndef f():\n    v = b.g()\n    v.a\n", "b": "def g():\n    return None\n"}, {("a", "v", "attribute", 1)}),
    "local receiver": ({"a": "def f(b):\n    v = b.g()\n    v.a\n", "b": "def g():\n    return None\n"}, set()),
    "receiver after barrier": ({"a": "def f(b):\n    try:\n        pass\n    except E:\n        pass\n    v = b.g()\n    v.a\n", "b": "def g():\n    return None\n"}, {("a", "v", "attribute", 1)}),
    "ambiguous": ({"a": "def f():\n    v = g()\n    v.a\n", "b": "def g():\n    return None\n", "c": "def g():\n    return 1\n"}, set()),
    "attributed to callee's file": ({"a": "def f():\n    d(None)\n", "b": "def d(y):\n    y[0]\n"}, {("b", "y", "subscript", 1)}),
}


def found(df):
    rows = df.groupBy("ws", "uri", "symbol", "kind").count().collect()
    out = {}
    for r in rows:
        out.setdefault(r["ws"], set()).add((r["uri"], r["symbol"], r["kind"], r["count"]))
    return out


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(n, u, t) for n, (fs, _) in CASES.items() for u, t in fs.items()], "ws string, uri string, text string")


@pytest.fixture(scope="module")
def functions(sources):
    return place(tapes(parse_sources(sources)))


@pytest.fixture(scope="module")
def solved(functions):
    return solve(functions)


@pytest.fixture(scope="module")
def answers(solved):
    return found(solved.regressions)


@pytest.mark.parametrize("name", CASES)
def test_workspace(name, answers):
    assert answers.get(name, set()) == CASES[name][1]


def test_byte_spans(solved):
    r = solved.regressions.where(F.col("ws") == "not ascii").first()
    text = CASES["not ascii"][0]["a"].encode()
    assert text[r["start_byte"]:r["end_byte"]] == b"x.a"


def test_file_scope(functions):
    answers = found(solve(functions, "file").regressions)
    assert answers.get("cross file", set()) == set()
    assert answers["three hops"] == {("a", "v", "attribute", 1)}
    assert answers.get("last definition wins in file", set()) == set()


def test_without_callees(functions):
    answers = found(intraprocedural(functions))
    assert answers.get("callee returns none", set()) == set()
    assert answers["none then attribute"] == {("a", "x", "attribute", 1)}


def test_summaries(solved):
    rows = {(r["ws"], r["func_name"]): r for r in solved.summaries.collect()}
    assert rows["passes through", "p"]["base"] == 1 and rows["passes through", "p"]["nfp"] == [True]
    assert rows["callee returns none", "g"]["base"] == 3
    assert rows["mixed returns", "g"]["base"] == 1
    assert rows["none then attribute", "f"]["base"] == 1


def test_unreadable_regions(sources, functions):
    assert [r["ws"] for r in file_unknowns(parse_sources(sources)).collect()] == ["broken header"]
    barriers = {r["ws"] for r in null_facts(functions).where("op = 'barrier'").collect()}
    assert {"broken statement", "broken neighbour", "try", "with"} <= barriers


def test_hot_callee_path_gives_the_same(functions, answers):
    """With a floor of zero every frequent name takes the broadcast path."""
    assert found(solve(functions).regressions) == answers


READ = {
    "a header of more than 200 lines": ("def f(" + ",\n".join(f"a{i}=None" for i in range(210)) + "):\n    a0.x\n    z z\n", ["a0"]),
    "blanks before a call's parentheses": ("def g(q=None):\n    len" + " " * 90 + "(q.a)\n", ["q"]),
    "a line break before a call's parentheses": ("def g(q=None):\n    len \\\n  (q.a)\n", ["q"]),
    "text at the margin inside a string": ('def f(x=None):\n    """a\nb\n"""\n    x.a\ndef broken(:\n    pass\n', ["x"]),
    "a bracket that is never closed": ("y = (1,\ndef f(x=None):\n    x.a\n", ["x"]),
    "a coding declaration": ("# -*- coding: latin-1 -*-\ndef f(x=None):\n    s = 'é'; x.a\n", ["x"]),
    "a byte order mark": ("\ufeffdef f(x=None):\n    x.a\n", ["x"]),
    "a string that is never closed": ('s = "\ndef f(x=None):\n    x.a\n', ["x"]),
}


def test_reading_loses_no_code(spark):
    """Every sound dereference is found at its place, whatever stands around it."""
    names = list(READ)
    src = spark.createDataFrame([("w", n, READ[n][0]) for n in names], "ws string, uri string, text string")
    got = {}
    for r in intraprocedural(place(tapes(parse_sources(src)))).collect():
        text = READ[r["uri"]][0].encode()
        assert text[r["start_byte"]:r["end_byte"]].decode() == f"{r['symbol']}.{text[r['end_byte'] - 1:r['end_byte']].decode()}"
        got.setdefault(r["uri"], []).append(r["symbol"])
    assert got == {n: READ[n][1] for n in names}
