"""The task that reads a text makes the tape that the expressions over its nodes make."""

import itertools
import random

from deflow.functions.annotations import annotation_code, annotation_value
from deflow.operators.facts import tapes
from deflow.operators.solver import intraprocedural, place
from deflow.plans.language import FORMS
from deflow.plans.programs import told
from deflow.plans.workspace import analyse, edited
from deflow.sources.code import TAPE_DDL, file_unknowns, parse_sources, read_tapes, read_unknowns

TEXTS = [
    "def f(a, b: int = None, c: Optional[str] = 3, *r: int, k=None, **w):\n    (yield)\n    a: str = b\n    x: 'None' = f(a)(b)\n    y: int\n    x = a.b(c, None, k=1, *r)\n",
    "def f(a):\n    if (a.b):\n        a.c(1, 'x', [2], -1, a)\n    elif not (a):\n        a[0] = m.n.o(a)\n    while ((a is not None)):\n        a += g(a)\n    for x, y in a.items():\n        x.z\n    return (a)\n",
    "def f(a):\n    a = b = None\n    a, b = b, a\n    assert None == a, 'no'\n    if a == b or a is b:\n        return a if a else None\n    lambda q: q.r\n    with a as b:\n        b.c\n    @d\n    def g(): return 1\n    return\n",
    "def f():\n    z z\n    return f'{a.b}'\n\nz z\nclass C:\n    pass\n\nasync def g(a=(None)):\n    await a.b\n    print a.c\n    match a:\n        case None: a.d\n",
    "", None, "x = 1\n", "def f(é=None):\n    é.x\n\tb\n",
]
TYPES = ["None", " NoneType ", "Optional[int]", "t.Optional[int]", "Optional", "Union[int, None]", "Union[int, str]", "int | None", "int|str", "int", "x.int",
         "List[int]", "List[None]", "Dict", "typing.List[int]", "'None'", "A.None", "None_", "Callable[..., None]", "", "  ", "int\n", "a.\nOptional[b]", "Optional [x]"]


def key(row):
    return row["ws"], row["uri"], row["fn"]


def test_tapes_equal_those_of_the_expressions(spark):
    rnd, texts = random.Random(7), TEXTS + [t.replace("~", "\n") for _, t, _ in FORMS]
    for t in [t for t in texts if t] * 3:
        lines = t.split("\n")
        i, j = rnd.randrange(len(lines)), rnd.randrange(len(lines))
        lines[i], lines[j] = lines[j], lines[i]
        texts.append("\n".join(lines))
    files = spark.createDataFrame([("ws", str(i), t) for i, t in enumerate(texts)], "ws string, uri string, text string")
    want = sorted(map(lambda r: r.asDict(True), tapes(parse_sources(files)).collect()), key=key)
    got = sorted(map(lambda r: r.asDict(True), read_tapes(files).collect()), key=key)
    assert len(want) > 60 and got == want


def test_annotations_say_the_same(spark):
    texts = TYPES + [a + b for a, b in itertools.product(["Optional", "Union", "Set", "m.Set"], ["[None]", " | None", "[a.b]", "\t"])]
    rows = spark.createDataFrame([(t,) for t in texts + [None]], "t string").selectExpr("t", f"{annotation_code('t')} AS code").collect()
    assert [(r["t"], annotation_value(r["t"])) for r in rows] == [(r["t"], r["code"]) for r in rows]


def test_queries_over_facts_get_no_nodes(spark):
    files = spark.createDataFrame([("ws", "u", "def f(a=None):\n    a.x\n")], "ws string, uri string, text string")
    read = told(spark, ("no such key",), files)
    assert "nodes" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert read.schema.simpleString() == spark.createDataFrame([], TAPE_DDL).schema.simpleString()
    assert [(r["n_params"], len(r["tape"])) for r in read.collect()] == [(1, 2)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_what_one_function_tells_needs_no_place(spark):
    texts = [t.replace("~", "\n") for _, t, _ in FORMS] + ["def f(a):\n    a = None\n    if b:\n        a.x\n    a.x\n"]
    files = spark.createDataFrame([("ws", str(i), t) for i, t in enumerate(texts)], "ws string, uri string, text string")
    read = intraprocedural(read_tapes(files))
    assert "Join" not in read._jdf.queryExecution().optimizedPlan().toString()
    want = rows(intraprocedural(place(read_tapes(files))))
    assert len(want) > 20 and rows(read) == want


def test_unreadable_regions_come_without_functions(spark):
    texts = [t for t in TEXTS if t] + [t.replace("~", "\n") for _, t, _ in FORMS]
    files = spark.createDataFrame([("ws", str(i), t) for i, t in enumerate(texts)], "ws string, uri string, text string")
    read = read_unknowns(files)
    assert "nodes" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert len(rows(read)) > 2 and rows(read) == rows(file_unknowns(parse_sources(files)))


def test_edits_are_read_once(spark):
    text = "def f(a=None):\n    a.x\n"
    state = analyse(spark.createDataFrame([("ws", str(i), text) for i in range(6)], "ws string, uri string, text string"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edits = spark.createDataFrame([("ws", "1", text.replace("x", "y")), ("ws", "2", None)], "ws string, uri string, text string")
    after = edited(state, edits.mapInArrow(counted, edits.schema))
    assert sorted(r["uri"] for r in after.solved.regressions.collect()) == ["0", "1", "3", "4", "5"]
    assert seen.value == 2
