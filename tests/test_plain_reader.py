"""Common statements are read without a syntax tree, with the results of Python's own parser."""

import random

import pytest

from deflow.plans.language import FORMS
from deflow.sources import syntax
from deflow.sources.syntax import read_functions, read_whole

PLAIN = """# a comment
import m.n

def f(a, b: int = None, c='x'):
    v = g(b, a.b[0].run(1))
    if not v == None:
        a.x = v

    elif v is not a:    # another
        while a:
            a.next()
            break
    else:
        for x in a.all(c):
            pass
    assert a
    return a is None


def g():
    return
"""
PIECES = ["z z", "(", "]", "'", ":", ";", " = ", " is ", "else:", "elif y:", "if x:", "while q:", "for i in j:", "def k(a):", "return", "\n", "    ", "# c",
          "@d", "\\", "\t", "é", "'''", ",", ".", "01", "1.5", "print x", "async ", "try:", "except E:", "}", ":=", "f''", "match x:", "f(k=1, a.b)", "a.e;"]


def refuse(*_):
    raise AssertionError("Python's parser was asked")


def test_common_statements_need_no_syntax_tree(monkeypatch):
    want = read_whole(PLAIN)
    monkeypatch.setattr(syntax, "_parse", refuse)
    assert read_functions(PLAIN) == want
    assert [f["name"] for f in want[0]] == ["f", "g"]


def test_only_an_unknown_statement_is_parsed(monkeypatch):
    text = PLAIN.replace("    assert a\n", "    z z\n    a, b = b, a\n")
    want, asked, parse = read_whole(text), [], syntax._parse
    monkeypatch.setattr(syntax, "_parse", lambda data: asked.append(data) or parse(data))
    assert read_functions(text) == want
    assert asked == [b"if 1:\n    z z\n", b"if 1:\n    a, b = b, a\n"]


@pytest.mark.parametrize("text", ["", " ", "x", "    x\n", "def f(", "def f(): pass", "def f():\n    }\n    a.b\n", "def f(a):\n    a.b;\n", "def f():\n    x = 1\n  y\n",
                                  "if a:\n    z z\n", "def f(a):\n    import a.}b\n    a.b\n", "else:\n", "def f():\n    while a:\n        a.b\n    else:\n        c.d\n"])
def test_unusual_texts(text):
    assert read_functions(text) == read_whole(text)


def test_changed_texts_are_read_as_by_the_parser():
    rnd, texts = random.Random(5), [t.replace("~", "\n") for _, t, _ in FORMS] + [PLAIN]
    for text in texts * 12:
        for _ in range(rnd.randrange(4)):
            lines = text.split("\n")
            i, at = rnd.randrange(len(lines)), rnd.randrange(len(text) + 1)
            if rnd.random() < 0.5:
                text = text[:at] + rnd.choice(PIECES) + text[at + rnd.randrange(2):]
            else:
                lines.insert(i, lines[i][:len(lines[i]) - len(lines[i].lstrip())] + rnd.choice(PIECES))
                text = "\n".join(lines)
        try:
            want = read_whole(text)
        except IndexError:      # a fault of the recovery that is as it was
            continue
        assert read_functions(text) == want, text
