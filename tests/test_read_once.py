"""What is read, closed over or traced once is not read, closed over or traced again."""

import pytest

from deflow.operators import solver
from deflow.operators.facts import tapes
from deflow.operators.solver import place, solve
from deflow.operators.witness import returning_none, witnesses
from deflow.sources import syntax
from deflow.sources.code import parse_sources

FILES = {
    "leaf": "def leaf(p):\n    return None\n",
    "middle": "def middle(q):\n    w = leaf(q)\n    return w\n",
    "top": "def top(r):\n    v = middle(None)\n    v.run()\n",
    "apart": "def apart(s):\n    s.run()\n    z z\n",
}


@pytest.fixture(scope="module")
def state(spark):
    sources = spark.createDataFrame([("ws", u, t) for u, t in FILES.items()], "ws string, uri string, text string")
    return solve(place(tapes(parse_sources(sources))))


def test_the_solution_keeps_the_reached_contexts(state):
    assert {(r.uri, r.ctx) for r in state.reached.collect()} == {("middle", 0), ("leaf", 0)}


def test_names_are_resolved_from_a_copy_without_tapes(state, monkeypatch):
    kept = []
    monkeypatch.setattr(solver, "cut", lambda df, *a, **k: kept.append(df.columns) or df)
    links, _ = solver.resolve(state.functions, "workspace")
    assert {(r.uri, r.callee, r.c_uri) for r in links.collect()} == {("middle", "leaf", "leaf"), ("top", "middle", "middle")}
    assert "callees" in kept[0] and "tape" not in kept[0] and "ctxs" not in kept[0]


def test_traces_go_on_in_functions_that_return_none(state):
    told = returning_none(state)
    assert {r.uri for r in told.select("uri").collect()} == {"leaf", "middle"} and "ctxs" not in told.columns
    found = [[s.kind for s in r.witness] for r in witnesses(state).collect() if r.uri == "top"]
    assert found == [["none_assignment", "call_return", "call_return", "consumer"]]


@pytest.mark.parametrize("text", ["def f(a=None):\n    a.x\n    z z\n", "def f(a=None):\n    if a:\n        z z\n    a.x\n", "z z\n"])
def test_no_text_is_parsed_twice(monkeypatch, text):
    seen, parse = [], syntax._parse
    monkeypatch.setattr(syntax, "_parse", lambda data: seen.append(data) or parse(data))
    syntax.read_functions(text)
    assert len(seen) == len(set(seen))
