"""Error-tolerant reading of Python text into flat syntax nodes.

This is the only Python-aware code that runs outside the JVM. It knows how to find root-level
functions in possibly broken text and how to number their syntax nodes; every meaning given to
those nodes (facts, conditions, narrowing) is a Spark expression in ``operators.facts``.

Nodes are numbered in evaluation order (a value before its target, an iterable before the loop
variable), so ``[i, i + size)`` is the subtree of node ``i`` and array order is execution order.
Children have fixed places: an assignment has [value, target], a parameter [name, default], a guarded
statement its condition first, a dereference or call its object first. ``name`` is an identifier or
attribute name, a comparison's operator, or the annotation text of a parameter or assignment.

Text that does not parse is recovered in a tree of its blocks: a statement whose clauses have sound headers
keeps them, whatever stands inside, and each of its blocks is recovered in turn; a line of several statements
is taken apart at its semicolons. Only what is left becomes an ERROR node, at the depth where it stands.
"""

from __future__ import annotations

import ast
import keyword
import re
from ast import Name
from bisect import bisect_left

# Syntax-node names for Python's own node classes; anything absent keeps its class name.
EXPRESSION_KIND = {
    "Name": "identifier", "Attribute": "attribute", "Subscript": "subscript", "Call": "call",
    "List": "list", "Set": "set", "Dict": "dictionary", "JoinedStr": "string", "TemplateStr": "string",
    "Compare": "comparison_operator", "Starred": "list_splat", "NamedExpr": "named_expression",
}
STATEMENT_KIND = {
    "Try": "try_statement", "TryStar": "try_statement", "With": "with_statement",
    "AsyncWith": "with_statement", "Match": "match_statement", "If": "if_statement",
    "While": "while_statement", "For": "for_statement", "AsyncFor": "for_statement",
    "Return": "return_statement", "Assert": "assert_statement",
    "Expr": "expression_statement", "Assign": "expression_statement",
    "AnnAssign": "expression_statement", "AugAssign": "expression_statement",
}
PARAMETER_KIND = {   # by whether there is an annotation, and a default
    (False, False): "parameter", (True, False): "typed_parameter",
    (False, True): "default_parameter", (True, True): "typed_default_parameter",
}
COMPARE = {"Is": "is", "IsNot": "is not", "Eq": "==", "NotEq": "!="}
FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)
CONTINUES = re.compile(rb"(else|elif|except|finally)\b|[)\]}#@]")
# What matters for where a statement's line ends: strings, comments, brackets, line breaks.
_MARKS = re.compile(rb"""(?P<long>\"\"\"|\'\'\')|(?P<short>["\'])|(?P<comment>\#[^\r\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<skip>\\(?:\r\n|[\s\S]))|(?P<line>\r\n|\r|\n)""")
_SHORT = {q: re.compile(rb"(?:[^" + q + rb"\\\r\n]|\\(?:\r\n|[\s\S]))*" + q) for q in (b'"', b"'")}
_LONG = {q: re.compile(rb"(?:[^\\]|\\[\s\S])*?" + q) for q in (b'"""', b"'''")}
_CUT = re.compile(_MARKS.pattern + rb"|(?P<cut>[:;])")
_CLAUSE = re.compile(rb"(else|elif|except|finally)\b")
# Statements of older grammars that say nothing about values: their word, and what follows it.
_OLD = re.compile(rb"(print|exec)\b[ \t]*(?:>>)?(?![ \t]*[(=.:,\[])(?P<rest>.+)", re.S)
_KEYWORD = re.compile(rb"[A-Za-z_]\w*[ \t]*(?P<sign>=)(?!=)")
# What stands beside an expression in grouping parentheses.
_BEFORE, _BEHIND = frozenset(b"( \t\r\n"), frozenset(b") \t\r\n\\")
# Words that begin a statement and never continue an expression: an open bracket before one was never closed.
_BEGINS = re.compile(rb"[ \t]*(?:def|class|return|import|from|while|with|try|assert|raise|del|pass|break|continue|global|nonlocal)\b")


class _Lines:
    """Byte offsets of line starts, for turning (line, utf-8 column) into a byte position."""

    def __init__(self, raw: bytes):
        self.raw = raw
        # A byte order mark is no part of the first line.
        self.starts = [3 * raw.startswith(b"\xef\xbb\xbf")] + [m.end() for m in re.finditer(rb"\r\n|\r|\n", raw)]

    def logical(self) -> list[bool]:
        """For each line, whether it begins outside of brackets, strings and continued lines."""
        raw, begins, depth, at, line = self.raw, [True] + [False] * (len(self.starts) - 1), 0, self.starts[0], 0
        while m := _MARKS.search(raw, at):
            at, kind = m.end(), m.lastgroup
            if kind in ("long", "short"):
                end = (_LONG if kind == "long" else _SHORT)[m.group()].match(raw, at)
                at = end.end() if end else at   # a string that never ends is a stray quote
            elif kind == "open":
                depth += 1
            elif kind == "close":
                depth = max(0, depth - 1)
            elif kind == "line":
                line = bisect_left(self.starts, at, line)
                if depth and _BEGINS.match(raw, at):
                    depth = 0
                begins[line] = depth == 0
        return begins

    def text(self, first: int, last: int) -> bytes:
        if first >= len(self.starts):
            return b""
        end = self.starts[last] if last < len(self.starts) else len(self.raw)
        return self.raw[self.starts[first]:end]


class _Numberer:
    """Appends one list per syntax node of a single function (fields as in ``sources.code``)."""

    def __init__(self, lines: _Lines, shift: int):
        self.raw, self.starts, self.shift = lines.raw, lines.starts, shift - 1
        self.nodes, self.slots = [], {}
        self.keywords: set[int] = set()     # where keyword arguments begin that are comparisons in the tree

    def extent(self, n) -> tuple[int, int]:
        """Span of a statement, which may be an unreadable one, or one with recovered blocks."""
        if isinstance(n, tuple):
            return n[:2]
        s, e = self.span(n)
        return s, getattr(n, "end_byte", e)

    def span(self, n: ast.AST) -> tuple[int, int]:
        s, d = self.starts, self.shift
        return s[n.lineno + d] + n.col_offset, s[n.end_lineno + d] + n.end_col_offset

    def open(self, kind, role, name, s, e, ctx, top, up) -> int:
        nodes = self.nodes
        i = len(nodes)
        slot = self.slots.setdefault(name, len(self.slots)) if kind == "identifier" else -1
        nodes.append([kind, role, name, s, e, ctx, i if top < 0 else top, up, [], 1, slot])
        if up >= 0:
            nodes[up][8].append(i)
        return i

    def close(self, i: int) -> None:
        self.nodes[i][9] = len(self.nodes) - i

    # -- expressions ---------------------------------------------------------------------------
    def before(self, at: int, lines: bool) -> int:
        """Place of the last byte before ``at`` that is no white space; ``lines`` passes over line breaks as well."""
        raw, a = self.raw, at - 1
        while a >= 0 and (raw[a] in b" \t\x0c" or raw[a] in b"\r\n" and (lines or raw[a - 1:a] in (b"\\", b"\r")) or raw[a] == 92):
            a -= 1
        return a

    def around(self, s: int, e: int, argument: bool = False) -> tuple[int, int] | None:
        """Span of the grouping parentheses directly around ``[s, e)``, if there are any.

        Parentheses behind a name, a literal or a closing bracket are a call's own. A line break may stand
        between the two only inside brackets, and then what they hold is an ``argument``.
        """
        raw, a, b = self.raw, s - 1, e
        while a >= 0 and raw[a] in b" \t\r\n\\":
            a -= 1
        if a < 0 or raw[a] != 40:
            return None
        while b < len(raw) and raw[b] in b" \t\r\n\\":
            b += 1
        if b >= len(raw) or raw[b] != 41:
            return None
        last = self.before(a, argument)
        first = last
        while first >= 0 and (raw[first] == 95 or raw[first] >= 128 or raw[first:first + 1].isalnum()):
            first -= 1
        word = raw[first + 1:last + 1]
        if (word and not keyword.iskeyword(word.decode("utf-8", "replace"))) or (not word and last >= 0 and raw[last] in b")]}'\""):
            return None
        return a, b + 1

    def expr(self, n: ast.AST, role: str, ctx: str, top: int, up: int) -> None:
        """Number ``n``; grouping parentheses around it become nodes of their own."""
        raw, starts, d = self.raw, self.starts, self.shift
        s, e = starts[n.lineno + d] + n.col_offset, starts[n.end_lineno + d] + n.end_col_offset
        # Most expressions are rejected by the two bytes beside them.
        if not s or raw[s - 1] not in _BEFORE or e >= len(raw) or raw[e] not in _BEHIND:
            return self.plain(n, role, ctx, top, up, s, e)
        argument = role == "argument"
        w = self.around(s, e, argument)
        if w is None:
            return self.plain(n, role, ctx, top, up, s, e)
        wraps = []
        while w is not None:
            wraps.append(w)
            w = self.around(*w, argument)
        opened = []
        for a, b in reversed(wraps):
            up = self.open("parenthesized_expression", role, None, a, b, ctx, top, up)
            opened.append(up)
            role = "group"
        self.plain(n, role, ctx, top, up, s, e)
        for i in reversed(opened):
            self.close(i)

    def plain(self, n: ast.AST, role: str, ctx: str, top: int, up: int, s: int, e: int) -> None:
        cls = n.__class__
        if cls is Name:     # about half of all nodes: numbered without a further call
            nodes, slots, name = self.nodes, self.slots, n.id
            i = len(nodes)
            nodes.append([
                "identifier", role, name, s, e, ctx, i if top < 0 else top, up, [], 1, slots.setdefault(name, len(slots))])
            if up >= 0:
                nodes[up][8].append(i)
        elif cls is ast.Constant:
            v = n.value
            kind = ("none" if v is None else "ellipsis" if v is ... else str(v).lower() if isinstance(v, bool)
                    else "string" if isinstance(v, (str, bytes)) else "integer" if isinstance(v, int) else "float")
            self.open(kind, role, None, s, e, ctx, top, up)
        elif cls is ast.Attribute:
            i = self.open("attribute", role, n.attr, s, e, ctx, top, up)
            self.expr(n.value, "object", ctx, top, i)
            self.close(i)
        elif cls is ast.Subscript:
            i = self.open("subscript", role, None, s, e, ctx, top, up)
            self.expr(n.value, "object", ctx, top, i)
            self.expr(n.slice, "index", ctx, top, i)
            self.close(i)
        elif cls is ast.Call:
            i = self.open("call", role, None, s, e, ctx, top, up)
            self.expr(n.func, "object", ctx, top, i)
            given = n.args + n.keywords if n.keywords else n.args
            for c in sorted(given, key=_place) if n.keywords else given:
                self.part(c, "argument", ctx, top, i)
            self.close(i)
        else:
            kind, name, inside = self.describe(n, cls, ctx, s, e)
            i = self.open(kind, role, name, s, e, ctx, top, up)
            for c in _parts(n):
                self.part(c, "operand", inside, top, i)
            self.close(i)

    def describe(self, n, cls, ctx: str, s: int, e: int) -> tuple[str, str | None, str]:
        """Kind, name and inner context of the less frequent expressions."""
        raw, name = self.raw, None
        kind = EXPRESSION_KIND.get(cls.__name__, cls.__name__)
        if cls in (ast.Tuple, ast.List) and ctx in ("left", "target") and isinstance(n.ctx, ast.Store):
            kind = "list_pattern" if cls is ast.List else "tuple_pattern" if raw[s] == 40 else "pattern_list"
        elif cls is ast.Tuple:
            bare = n.elts and (raw[s] != 40 or self.span(n.elts[0])[0] == s or raw[e - 1] != 41)
            kind = "expression_list" if bare else "tuple"
        elif cls is ast.UnaryOp:
            kind = "not_operator" if isinstance(n.op, ast.Not) else "unary_operator"
        elif cls is ast.Compare:
            name = COMPARE.get(n.ops[0].__class__.__name__, "other") if len(n.ops) == 1 else "other"
        return kind, name, "fstring" if kind == "string" else ctx

    def part(self, c, role: str, ctx: str, top: int, up: int) -> None:
        """A child that may be a keyword argument or a lambda parameter rather than an expression."""
        if c.__class__ is ast.keyword:
            s, e = self.span(c)
            i = self.open("dictionary_splat" if c.arg is None else "keyword_argument", role, None, s, e, ctx, top, up)
            if c.arg is not None:
                self.open("identifier", "keyword", c.arg, s, s + len(c.arg.encode()), ctx, top, i)
            self.expr(c.value, "value", ctx, top, i)
            self.close(i)
        elif self.keywords and c.__class__ is ast.Compare and self.span(c)[0] in self.keywords:
            s, e = self.span(c)
            i = self.open("keyword_argument", role, None, s, e, ctx, top, up)
            self.open("identifier", "keyword", c.left.id, s, self.span(c.left)[1], ctx, top, i)
            self.expr(c.comparators[0], "value", ctx, top, i)
            self.close(i)
        elif c.__class__ is ast.arg:
            s = self.span(c)[0]
            self.open("identifier", "lambda", c.arg, s, s + len(c.arg.encode()), ctx, top, up)
        else:
            self.expr(c, role, ctx, top, up)

    # -- statements ----------------------------------------------------------------------------
    def block(self, body, role: str, top: int, up: int) -> None:
        """``body`` holds parsed statements, and others as ``(start, end)``, unreadable, or with a kind behind."""
        ends = [self.extent(b) for b in (body[0], body[-1])]
        i = self.open("block", role, None, ends[0][0], ends[1][1], role, top, up)
        for b in body:
            self.statement(b, -1 if role == "body_of_function" else top, i)
        self.close(i)

    def statement(self, n, top: int, up: int, kind: str | None = None) -> None:
        if isinstance(n, tuple):
            self.open("ERROR" if len(n) == 2 else n[2], "statement", None, *n[:2], "statement", top, up)
            return
        cls, (s, e) = n.__class__, self.extent(n)
        kind = kind or STATEMENT_KIND.get(cls.__name__, cls.__name__)
        i = self.open(kind, "statement", None, s, e, "statement", top, up)
        top = i if top < 0 else top
        if cls is ast.Expr:
            v = n.value
            if isinstance(v, ast.Tuple) and v.elts and self.span(v.elts[0])[0] == self.span(v)[0]:
                v = v.elts[0]  # an unparenthesised tuple statement exposes its first element only
            self.expr(v, "value", "value", top, i)
        elif cls in (ast.Assign, ast.AnnAssign, ast.AugAssign):
            self.assignment(n, top, i, s, e)
        elif cls is ast.Return:
            if n.value is not None:
                self.expr(n.value, "value", "value", top, i)
        elif cls is ast.Assert:
            self.expr(n.test, "condition", "condition", top, i)
        elif cls is ast.If:
            self.expr(n.test, "condition", "condition", top, i)
            self.block(n.body, "consequence", top, i)
            if n.orelse:
                first = n.orelse[0]
                if len(n.orelse) == 1 and isinstance(first, ast.If) and self.raw.startswith(b"elif", self.span(first)[0]):
                    self.statement(first, top, i, "elif_clause")
                else:
                    self.block(n.orelse, "alternative", top, i)
        elif cls is ast.While:
            self.expr(n.test, "condition", "condition", top, i)
            self.block(n.body, "body", top, i)
        elif cls in (ast.For, ast.AsyncFor):
            self.expr(n.iter, "iterable", "iterable", top, i)
            self.expr(n.target, "target", "target", top, i)
            self.block(n.body, "body", top, i)
        self.close(i)

    def assignment(self, n, top: int, up: int, s: int, e: int) -> None:
        targets = n.targets if n.__class__ is ast.Assign else [n.target]
        kind = "augmented_assignment" if n.__class__ is ast.AugAssign else "assignment"
        i = self.open(kind, "value", self.annotation(getattr(n, "annotation", None)), s, e, "value", top, up)
        if len(targets) > 1:  # a = b = v binds only the first name; the rest is its value
            j = self.open("assignment", "right", None, self.span(targets[1])[0], e, "right", top, i)
            for t in targets[1:]:
                self.expr(t, "chained", "right", top, j)
            self.expr(n.value, "value", "right", top, j)
            self.close(j)
        elif n.value is not None:
            self.expr(n.value, "right", "right", top, i)
        self.expr(targets[0], "left", "left", top, i)
        self.close(i)

    def annotation(self, n) -> str | None:
        return None if n is None else self.raw[slice(*self.span(n))].decode("utf-8", "replace")

    def parameters(self, a: ast.arguments) -> None:
        plain = a.posonlyargs + a.args
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        rows = [(x, d, None) for x, d in zip(plain, defaults)]
        if a.kwonlyargs or a.vararg or a.kwarg:
            rows += [(x, d, None) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
            rows += [(x, None, k) for x, k in ((a.vararg, "list_splat_pattern"), (a.kwarg, "dictionary_splat_pattern")) if x]
            rows.sort(key=lambda r: _place(r[0]))
        for x, default, splat in rows:
            s = self.span(x)[0]
            e = s + len(x.arg.encode())
            kind = splat if splat and not x.annotation else PARAMETER_KIND[x.annotation is not None, default is not None]
            i = self.open(kind, "parameter", self.annotation(x.annotation), s, e, "parameter", -1, -1)
            if not (splat and x.annotation):
                self.open("identifier", "name", x.arg, s, e, "parameter", i, i)
            if default is not None:
                ds, de = self.span(default)
                bare_none = isinstance(default, ast.Constant) and default.value is None and not self.around(ds, de)
                self.open("none" if bare_none else "expression", "default", None, ds, de, "default", i, i)
            self.close(i)


def _place(n: ast.AST) -> tuple[int, int]:
    return n.lineno, n.col_offset


def _parts(n: ast.AST) -> list[ast.AST]:
    """Children with a place of their own, in source order."""
    flat, todo = [], list(ast.iter_child_nodes(n))
    while todo:
        c = todo.pop()
        if isinstance(c, (ast.arguments, ast.comprehension)):
            todo.extend(ast.iter_child_nodes(c))
        elif hasattr(c, "lineno"):
            flat.append(c)
    return sorted(flat, key=_place)


def _function(lines: _Lines, n, shift: int, body=None, keywords: set[int] | None = None) -> dict:
    num = _Numberer(lines, shift)
    num.keywords = keywords or set()
    num.parameters(n.args)
    num.block(body if body is not None else n.body, "body_of_function", -1, -1)
    s, e = num.span(n)
    if body is not None:
        e = num.extent(body[-1])[1]
    return {"name": n.name, "s": s, "e": e, "nodes": num.nodes}


def _parse(data: bytes) -> ast.Module:
    """Text, not bytes, so that a coding declaration cannot shift columns: the bytes are UTF-8 by now."""
    return compile(data.decode("utf-8", "surrogatepass"), "<unknown>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)


def _chunks(lines: _Lines, logical: list[bool], first: int, last: int, indent: int):
    """Split lines ``[first, last)`` where a statement starts at ``indent`` and does not continue the one before."""
    cuts = []
    for i in range(first, last):
        t = lines.text(i, i + 1)
        body = t.lstrip(b" \t")
        if not logical[i] or not body.strip() or len(t) - len(body) > indent:
            continue
        decorator = cuts and cuts[-1] == i - 1 and lines.text(i - 1, i).lstrip().startswith(b"@")
        if body.startswith(b"@"):
            if not decorator:
                cuts.append(i)
        elif not CONTINUES.match(body) and not (cuts and lines.text(i - 1, i).lstrip().startswith(b"@")):
            cuts.append(i)
    return list(zip(cuts, cuts[1:] + [last]))


def _blank(raw: bytes) -> bytes:
    """White space of the same shape, so that what follows keeps its place."""
    return re.sub(rb"[^\r\n]", b" ", raw)


def _cuts(raw: bytes, mark: bytes) -> list[int]:
    """Places of ``mark`` outside of brackets and strings."""
    out, depth, at = [], 0, 0
    while m := _CUT.search(raw, at):
        at, kind = m.end(), m.lastgroup
        if kind in ("long", "short"):
            end = (_LONG if kind == "long" else _SHORT)[m.group()].match(raw, at)
            at = end.end() if end else at
        elif kind in ("open", "close"):
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif kind == "cut" and not depth and m.group() == mark:
            out.append(m.start())
    return out


class _Recovery:
    """Statements of one broken function, whose first line is ``first``."""

    def __init__(self, lines: _Lines, logical: list[bool], first: int):
        self.lines, self.logical, self.first = lines, logical, first
        self.keywords: set[int] = set()
        self.failed: set[bytes] = set()     # text that was tried before, as a whole and as its only piece

    def read(self, raw: bytes, line: int) -> list[ast.stmt] | None:
        """The statements of ``raw``, indented text that begins with line ``line``."""
        if raw in self.failed:
            return None
        try:
            found = _parse(b"if 1:\n" + raw).body[0].body
        except FAILURES:
            self.failed.add(raw)
            return None
        for s in found:
            ast.increment_lineno(s, line - 1 - self.first)
        return found

    def below(self, line: int, last: int) -> list:
        """The statements of a block that begins behind ``line``."""
        begin, out = self.shown(line, last), []
        if begin is not None:
            t = self.lines.text(begin, begin + 1)
            for a, b in _chunks(self.lines, self.logical, begin, last, len(t) - len(t.lstrip(b" \t"))):
                out += self.chunk(a, b)
        return out

    def shown(self, line: int, last: int) -> int | None:
        """The first line from ``line`` on that begins a statement."""
        return next((i for i in range(line, last) if self.logical[i] and self.lines.text(i, i + 1).strip() and not self.lines.text(i, i + 1).lstrip().startswith(b"#")), None)

    def chunk(self, a: int, b: int) -> list:
        """One statement with all that belongs to it, in the largest parts that can be read."""
        raw = self.lines.text(a, b)
        found = self.read(raw, a)
        if found is None:
            try:
                found = self.clauses(a, b)
            except RecursionError:      # blocks nested deeper than anyone writes them
                found = None
        if found is None:
            found = self.line(raw, a, 0) if self.shown(self.end_of(a, b), b) is None else None
        return found if found is not None else [self.error(a, raw)]

    def error(self, line: int, raw: bytes, kind: str | None = None) -> tuple:
        at = self.lines.starts[line]
        span = at + len(raw) - len(raw.lstrip()), at + len(raw.rstrip())
        return span if kind is None else (*span, kind)

    def end_of(self, a: int, b: int) -> int:
        """The line behind the logical line that begins with line ``a``."""
        return next((i for i in range(a + 1, b) if self.logical[i]), b)

    def clauses(self, a: int, b: int) -> list | None:
        """A compound statement with recovered blocks; None where its first header cannot be read."""
        t = self.lines.text(a, a + 1)
        indent = len(t) - len(t.lstrip(b" \t"))
        begins = [a] + [i for i in range(a + 1, b) if self.logical[i] and _CLAUSE.match(x := self.lines.text(i, i + 1).lstrip(b" \t")) and len(self.lines.text(i, i + 1)) - len(x) <= indent]
        shape, blocks, rest = b"", [], []
        for i, j in zip(begins, begins[1:] + [b]):
            stop = self.end_of(i, j)
            head, tail = self.lines.text(i, stop), self.lines.text(stop, j)
            for cut in _cuts(head, b":"):
                line_end = head[cut + 1:]
                own = head[:cut + 1] + b" pass" + b"".join(re.findall(rb"\r\n|\r|\n", line_end))
                if self.whole(shape + own, a, indent):
                    break
            else:
                if i == a:
                    return None
                rest = [self.error(i, self.lines.text(i, b))]
                break
            inline = line_end.strip() and not line_end.strip().startswith(b"#")
            blocks.append(self.line(head, i, cut + 1) if inline else self.below(stop, j))
            shape += own + _blank(tail)
        n = self.whole(shape, a, indent)
        self.fill(n, blocks)
        return [n, *rest]

    def whole(self, shape: bytes, line: int, indent: int) -> ast.stmt | None:
        """The one statement of ``shape``; a ``try`` may still lack the clauses behind it."""
        for more in (b"", b"\n" + b" " * indent + b"finally: pass"):
            found = self.read(shape + more, line)
            if found is not None and len(found) == 1:
                return found[0]
        return None

    def fill(self, n: ast.stmt, blocks: list[list]) -> None:
        """Put the recovered blocks of a branch or loop in their places; other statements show none."""
        chain = [n]
        for k, block in enumerate(blocks):
            if not block or not isinstance(n, (ast.If, ast.While, ast.For, ast.AsyncFor)):
                continue
            if k == 0:
                n.body = block
            elif isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If):
                n = n.orelse[0]     # an elif clause
                n.body = block
                chain.append(n)
            else:
                n.orelse = block
        last = next((b[-1] for b in reversed(blocks) if b), None)
        if last is not None:
            for n in chain:
                n.end_byte = _Numberer(self.lines, self.first).extent(last)[1]

    def line(self, raw: bytes, line: int, begin: int) -> list:
        """The simple statements of a logical line from byte ``begin`` on, each read for itself."""
        ends = [begin - 1, *(c for c in _cuts(raw, b";") if c >= begin), len(raw)]
        out = []
        for p, q in zip(ends, ends[1:]):
            piece = raw[p + 1:q]
            if not piece.strip() or piece.strip().startswith(b"#"):
                continue
            before = _blank(raw[:p + 1])
            found = self.read(before + piece, line)
            out += found if found is not None else self.foreign(before, piece, line)
        return out

    def foreign(self, before: bytes, piece: bytes, line: int) -> list:
        """Statements that other grammars of the language take; else the piece is an error."""
        old = _OLD.match(piece.strip())
        if old and self.read(b" (" + old["rest"].strip().rstrip(b",") + b")", line):
            return [self.error(line, before + piece, f"{old[1].decode()}_statement")]
        # A positional argument behind a keyword argument: the sign becomes one that may stand there.
        text, marks = bytearray(before + piece), set()
        for m in _KEYWORD.finditer(before + piece):
            if not _outside(before + piece, m.start()):
                text[m.start("sign")] = ord("<")
                marks.add(self.lines.starts[line] + m.start())
        found = self.read(bytes(text), line) if marks else None
        if not found:
            return [self.error(line, before + piece)]
        num, seen = _Numberer(self.lines, self.first), set()
        for c in (x for s in found for c in ast.walk(s) if isinstance(c, ast.Call) for x in c.args):
            if isinstance(c, ast.Compare) and len(c.ops) == 1 and isinstance(c.left, ast.Name) and num.span(c)[0] in marks:
                seen.add(num.span(c)[0])
        if seen != marks:   # some sign stood in a place where it means something else
            return [self.error(line, before + piece)]
        self.keywords |= marks
        return found


def _outside(raw: bytes, at: int) -> bool:
    """Whether byte ``at`` stands outside of brackets (and of strings)."""
    return at in _cuts(raw[:at] + b";" + raw[at:], b";")


def _recover(lines: _Lines, logical: list[bool], first: int, last: int) -> dict | None:
    """A broken ``def``: keep its header if that parses, and recover what stands below it."""
    r = _Recovery(lines, logical, first)
    stop = r.end_of(first, last)
    head = lines.text(first, stop)
    for cut in _cuts(head, b":"):
        try:
            n = _parse(head[:cut + 1] + b" pass").body[0]
        except FAILURES:
            continue
        rest = head[cut + 1:].strip()
        body = r.line(head, first, cut + 1) if rest and not rest.startswith(b"#") else r.below(stop, last)
        return _function(lines, n, first, body, r.keywords) if body else None
    return None


class _Odd(Exception):
    """Text whose lines are not its logical lines, or that is out of the ordinary otherwise: it is read as a whole."""


class _Hole(Exception):
    """A statement that ``_Plain`` does not know, sound or not."""


# Text that is read line by line: printable ASCII without continued lines and long strings.
_STRANGE = re.compile("[^\\n -\\[\\]-~]|'''|\"\"\"")
# Words and numbers, strings, what ends a line up to the next statement's indentation, signs.
_TOKEN = re.compile(r""" *(\w+|[.(,):]|[=!]=|(?:(?:\#[^\n]*)?\n *)+|'[^'\n]*'|"[^"\n]*"|[^\w ])""")
_ENDS = ("\n", "#")
_CONSTANT = {"None": "none", "True": "true", "False": "false"}
_RESERVED = frozenset(keyword.kwlist) | {"__debug__"}
_CLAUSES = frozenset(("else", "elif", "except", "finally"))
_LEAF = {"pass": "Pass", "break": "Break", "continue": "Continue"}
_DEEP = 40      # nested blocks, calls and links of a chain; what goes deeper is left to Python's parser


class _Plain:
    """Reads and numbers common statements in one pass over their tokens, without a syntax tree.

    It knows names, constants, attributes, subscripts, calls with plain arguments, comparisons with one sign, ``not``,
    assignments to one target, ``return``, ``assert``, ``import`` of a module, branches and loops. Any other statement
    of a block, sound or not, is a hole: its lines are read as ``_Recovery`` reads them, and numbered in its place.
    A text of logical lines is sound just if all its statements are, so the result is that of reading it as a whole.
    """

    def __init__(self, text: str):
        if _STRANGE.search(text):
            raise _Odd
        self.source = text
        self.text = text if text.endswith("\n") else text + "\n"
        self.toks, self.starts, at = _TOKEN.findall(self.text), [], 0
        find, add = self.text.find, self.starts.append
        for tok in self.toks:   # nothing but spaces stands between two
            at = find(tok, at)
            add(at)
            at += len(tok)
        self.toks.append("")
        if "'" in self.toks or '"' in self.toks:    # a string that never ends
            raise _Odd
        self.nodes, self.slots, self._lines = [], {}, None

    def line_of(self, p: int) -> int:
        """The line of token ``p``; behind the last token, the one behind all lines."""
        return self.text.count("\n", 0, self.starts[p]) if self.toks[p] else len(self.lines.starts)

    def indent(self, p: int) -> int:
        """Indentation behind the line end ``p``."""
        tok = self.toks[p]
        if tok[:1] not in _ENDS:
            raise _Hole
        return len(tok) - tok.rfind("\n") - 1

    # -- expressions: (kind, name, start, end, first part, further parts) ------------------------
    def primary(self, p: int, depth: int = 0) -> tuple:
        toks, starts = self.toks, self.starts
        tok = toks[p]
        s = starts[p]
        e = s + len(tok)
        p += 1
        link = toks[p]
        if tok.isidentifier():
            if tok not in _RESERVED:
                tree = "identifier", tok, s, e, None, ()
                if link not in ("(", ".", "["):
                    return tree, p
                links = depth
                while True:
                    links += 1
                    if links > _DEEP:
                        raise _Hole
                    if link == ".":
                        tok = toks[p + 1]
                        if not tok.isidentifier() or tok in _RESERVED:
                            raise _Hole
                        e = starts[p + 1] + len(tok)
                        tree = "attribute", tok, s, e, tree, ()
                        p += 2
                    elif link == "(":
                        args = []
                        if toks[p + 1] == ")":
                            p += 1
                        else:
                            while True:
                                arg, p = self.primary(p + 1, links)
                                args.append(arg)
                                if toks[p] != ",":
                                    break
                            if toks[p] != ")":
                                raise _Hole
                        e = starts[p] + 1
                        tree = "call", None, s, e, tree, args
                        p += 1
                    elif link == "[":
                        index, p = self.primary(p + 1, links)
                        if toks[p] != "]":
                            raise _Hole
                        e = starts[p] + 1
                        tree = "subscript", None, s, e, tree, (index,)
                        p += 1
                    else:
                        return tree, p
                    link = toks[p]
            kind = _CONSTANT.get(tok)
        elif tok.isdigit():
            kind = "integer" if len(tok) < 18 and (tok == "0" or tok[0] != "0") else None
        else:
            kind = "string" if tok[:1] in ("'", '"') else None
        if kind is None or link in ("(", ".", "["):
            raise _Hole
        return (kind, None, s, e, None, ()), p

    def expression(self, p: int) -> tuple:
        toks = self.toks
        if toks[p] == "not":
            tree, q = self.comparison(p + 1)
            return ("not_operator", None, self.starts[p], tree[3], None, (tree,)), q
        return self.comparison(p)

    def comparison(self, p: int) -> tuple:
        left, p = self.primary(p)
        sign = self.toks[p]
        if sign not in ("is", "==", "!="):
            return left, p
        if sign == "is" and self.toks[p + 1] == "not":
            sign, p = "is not", p + 1
        right, p = self.primary(p + 1)
        return ("comparison_operator", sign, left[2], right[3], None, (left, right)), p

    def number(self, tree: tuple, role: str, ctx: str, top: int, up: int) -> None:
        kind, name, s, e, first, rest = tree
        nodes = self.nodes
        i = len(nodes)
        nodes[up][8].append(i)
        if kind == "identifier":
            slots = self.slots
            nodes.append([kind, role, name, s, e, ctx, top, up, [], 1, slots.setdefault(name, len(slots))])
            return
        node = [kind, role, name, s, e, ctx, top, up, [], 1, -1]
        nodes.append(node)
        if first is not None:
            self.number(first, "object", ctx, top, i)
            part = "index" if kind == "subscript" else "argument"
        else:
            part = "operand"
        for x in rest:
            self.number(x, part, ctx, top, i)
        node[9] = len(nodes) - i

    # -- statements ----------------------------------------------------------------------------
    def open(self, kind: str, role: str, s: int, ctx: str, top: int, up: int) -> list:
        nodes = self.nodes
        i = len(nodes)
        if up >= 0:
            nodes[up][8].append(i)
        node = [kind, role, None, s, -1, ctx, i if top < 0 else top, up, [], 1, -1]
        nodes.append(node)
        return node

    def statement(self, p: int, indent: int, top: int, up: int, depth: int, kind: str | None = None) -> tuple[int, int]:
        """Number the statement at ``p``: the line end behind it, and its end."""
        toks, nodes = self.toks, self.nodes
        word, i, s = toks[p], len(nodes), self.starts[p]
        t = i if top < 0 else top
        if word not in _RESERVED:
            tree, q = self.primary(p)
            node = self.open("expression_statement", "statement", s, "statement", top, up)
            if toks[q] == "=":
                if tree[0] not in ("identifier", "attribute", "subscript"):
                    raise _Hole
                value, q = self.expression(q + 1)
                e = value[3]
                inner = self.open("assignment", "value", s, "value", t, i)
                self.number(value, "right", "right", t, i + 1)
                self.number(tree, "left", "left", t, i + 1)
                inner[4], inner[9] = e, len(nodes) - i - 1
            else:
                if toks[q] in ("is", "==", "!="):
                    tree, q = self.comparison(p)
                e = tree[3]
                self.number(tree, "value", "value", t, i)
        elif word == "return":
            node, q, e = self.open("return_statement", "statement", s, "statement", top, up), p + 1, s + 6
            if toks[q][:1] not in _ENDS:
                value, q = self.expression(q)
                e = value[3]
                self.number(value, "value", "value", t, i)
        elif word in ("if", "while") or kind:
            node = self.open(kind or f"{word}_statement", "statement", s, "statement", top, up)
            value, q = self.expression(p + 1)
            self.number(value, "condition", "condition", t, i)
            q, e = self.block(q, indent, "body" if word == "while" else "consequence", t, i, depth)
            if word != "while" and self.indent(q) == indent:
                if toks[q + 1] == "elif":
                    q, e = self.statement(q + 1, indent, t, i, depth + 1, "elif_clause")
                elif toks[q + 1] == "else":
                    q, e = self.block(q + 2, indent, "alternative", t, i, depth)
        elif word == "assert":
            node = self.open("assert_statement", "statement", s, "statement", top, up)
            value, q = self.expression(p + 1)
            e = value[3]
            self.number(value, "condition", "condition", t, i)
        elif word == "for":
            if toks[p + 2] != "in":
                raise _Hole
            target, q = self.primary(p + 1)
            node = self.open("for_statement", "statement", s, "statement", top, up)
            value, q = self.primary(q + 1)
            self.number(value, "iterable", "iterable", t, i)
            self.number(target, "target", "target", t, i)
            if target[0] != "identifier":
                raise _Hole
            q, e = self.block(q, indent, "body", t, i, depth)
        elif word in _LEAF:
            node, q, e = self.open(_LEAF[word], "statement", s, "statement", top, up), p + 1, s + len(word)
        elif word == "import":
            node = self.open("Import", "statement", s, "statement", top, up)
            q = p
            while q == p or toks[q] == ".":
                q += 1
                if not toks[q].isidentifier() or toks[q] in _RESERVED:
                    raise _Hole
                e = self.starts[q] + len(toks[q])
                q += 1
        else:
            raise _Hole
        if toks[q][:1] not in _ENDS:
            raise _Hole
        node[4], node[9] = e, len(nodes) - i
        return q, e

    def followed(self, p: int, indent: int) -> bool:
        """Whether another statement of a block follows the line end ``p``."""
        tok = self.toks[p]
        n = len(tok) - tok.rfind("\n") - 1
        if n > indent or n == indent and self.toks[p + 1] in _CLAUSES:
            raise _Hole
        return n == indent and self.toks[p + 1] != ""

    def block(self, p: int, outer: int, role: str, top: int, up: int, depth: int) -> tuple[int, int]:
        """Number the block behind the colon at ``p``: the line end behind it, and its end."""
        indent = self.indent(p + 1) if self.toks[p] == ":" else 0
        if indent <= outer:
            raise _Hole
        if depth > _DEEP:
            raise _Odd
        nodes, slots = self.nodes, self.slots
        i = len(nodes)
        node = self.open("block", role, -1, role, top, up)
        more, p, s, e = True, p + 1, -1, -1
        while more:
            at, known = len(nodes), len(slots)
            try:
                q, e = self.statement(p + 1, indent, top, i, depth + 1)
                more = self.followed(q, indent)
                if s < 0:
                    s = self.starts[p + 1]
            except _Hole:
                if self.first < 0:      # at root level a statement is sound or unreadable as a whole
                    raise
                self.starts_one(p + 1)
                del nodes[at:]
                while node[8] and node[8][-1] >= at:
                    node[8].pop()
                while len(slots) > known:
                    slots.popitem()
                q = self.past(p + 1, indent)
                begin, end = self.hole(self.line_of(p + 1), self.line_of(q + 1), top, i)
                more = self.followed(q, indent)
                if begin is not None:
                    s, e = begin if s < 0 else s, end
            p = q
        if s < 0:   # nothing can be read
            raise _Odd
        node[3], node[4], node[9] = s, e, len(nodes) - i
        return p, e

    def hole(self, a: int, b: int, top: int, up: int) -> tuple[int | None, int]:
        """Number the unknown statements of the lines ``[a, b)``: where they begin and end."""
        raw, r = self.lines.text(a, b), self.recovery
        begin = end = None
        try:
            found, shift = _parse(b"if 1:\n" + raw).body[0].body, a - 1
        except FAILURES:
            r.failed.add(raw)
            found, shift = r.chunk(a, b), r.first
        num = _Numberer(self.lines, shift)
        num.nodes, num.slots, num.keywords = self.nodes, self.slots, r.keywords
        for x in found:
            s, end = num.extent(x)
            begin = s if begin is None else begin
            num.statement(x, top, up)
        return begin, end

    def past(self, p: int, indent: int) -> int:
        """The line end behind the unknown statement at ``p`` and all that belongs to it."""
        toks, depth = self.toks, 0
        while True:
            tok = toks[p]
            if tok in ("(", "[", "{"):
                depth += 1
            elif tok in (")", "]", "}"):
                depth = max(0, depth - 1)
            elif tok == ";" and toks[p + 1][:1] in _ENDS:   # it belongs to what is around the statement
                raise _Odd
            elif tok[:1] in _ENDS:
                n = len(tok) - tok.rfind("\n") - 1
                following = toks[p + 1]
                if depth or n > 100 or following[:1] in (")", "]", "}", "@") and following:
                    raise _Odd
                if n < indent or n == indent and following not in _CLAUSES:
                    return p
            p += 1

    def starts_one(self, p: int) -> None:
        """Decorators, and what continues a statement, are no statements of their own."""
        if self.toks[p][0] in ")]}@" or self.toks[p] in _CLAUSES:
            raise _Odd

    @property
    def lines(self) -> _Lines:
        if self._lines is None:
            self._lines = _Lines(self.source.encode())
        return self._lines

    @property
    def logical(self) -> list[bool]:
        return [True] * len(self.lines.starts)

    @property
    def recovery(self) -> _Recovery:
        """Of the function that begins at ``first``."""
        if self.recovered is None:
            self.recovered = _Recovery(self.lines, self.logical, self.line_of(self.first))
        return self.recovered

    def parameters(self, p: int) -> int:
        """Number the parameters from behind the opening parenthesis at ``p``: the place behind the closing one."""
        toks, given = self.toks, False
        if toks[p + 1] == ")":
            return p + 2
        while True:
            p += 1
            name = toks[p]
            if not name.isidentifier() or name in _RESERVED:
                raise _Hole
            s, i, text, default = self.starts[p], len(self.nodes), None, None
            p += 1
            if toks[p] == ":":
                note, p = self.primary(p + 1)
                text = self.text[note[2]:note[3]]
            if toks[p] == "=":
                default, p = self.primary(p + 1)
                given = True
            elif given:
                raise _Hole
            node = self.open(PARAMETER_KIND[text is not None, default is not None], "parameter", s, "parameter", -1, -1)
            node[2], node[4] = text, s + len(name)
            self.number(("identifier", name, s, s + len(name), None, ()), "name", "parameter", i, i)
            if default is not None:
                d = self.open("none" if default[0] == "none" else "expression", "default", default[2], "default", i, i)
                d[4] = default[3]
            node[9] = len(self.nodes) - i
            if toks[p] != ",":
                break
        if toks[p] != ")":
            raise _Hole
        return p + 1

    def function(self, p: int) -> tuple[dict, int]:
        """The function at ``p``, and the line end behind it; a hole where its header is not known."""
        toks, start = self.toks, p
        name = toks[p + 1]
        if not name.isidentifier() or name in _RESERVED or toks[p + 2] != "(":
            raise _Hole
        self.nodes, self.slots = [], {}
        p = self.parameters(p + 2)
        self.first, self.recovered = start, None
        p, e = self.block(p, 0, "body_of_function", -1, -1, 0)
        if self.indent(p):      # a line between the two indentations
            raise _Odd
        return {"name": name, "s": self.starts[start], "e": e, "nodes": self.nodes}, p

    def root(self) -> tuple[list[dict], list[tuple[int, int]]]:
        """What ``read_functions`` gives."""
        functions, errors, toks = [], [], self.toks
        p = -1
        if toks[0][:1] in _ENDS:
            p = 0
        if self.text[0] == " " and p or p == 0 and self.indent(0):
            raise _Odd
        while toks[p + 1]:
            try:
                if toks[p + 1] == "def":
                    found, q = self.function(p + 1)
                    functions.append(found)
                else:
                    self.nodes, self.slots = [], {}
                    self.first = -1
                    q, _ = self.statement(p + 1, 0, -1, -1, 1)
                    self.followed(q, 0)
            except _Hole:
                self.starts_one(p + 1)
                q = self.past(p + 1, 0)
                _part(self.lines, self.logical, self.line_of(p + 1), self.line_of(q + 1), functions, errors)
            p = q
        return functions, errors


def _take(lines: _Lines, module: ast.Module, shift: int, functions: list[dict]) -> None:
    for n in module.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.decorator_list:
            functions.append(_function(lines, n, shift))


def _part(lines: _Lines, logical: list[bool], a: int, b: int, functions: list[dict], errors: list[tuple[int, int]], failed: bool = False) -> None:
    """One chunk at root level, which may have ``failed`` before."""
    part = lines.text(a, b)
    try:
        if failed:
            raise SyntaxError
        _take(lines, _parse(part), a, functions)
    except FAILURES:
        found = _recover(lines, logical, a, b) if re.match(rb"(async[ \t]+)?def\b", part) else None
        if found:
            functions.append(found)
        elif not part.startswith(b"@"):
            errors.append((lines.starts[a], lines.starts[a] + len(part.rstrip())))


def read_functions(text: str) -> tuple[list[dict], list[tuple[int, int]]]:
    """Root-level undecorated functions of ``text`` and the byte spans of unreadable root regions."""
    try:
        return _Plain(text).root()
    except (_Odd, *FAILURES):
        return read_whole(text)


def read_whole(text: str) -> tuple[list[dict], list[tuple[int, int]]]:
    """The same by Python's own parser, whatever the text holds."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = _Lines(raw)
    functions, errors = [], []
    whole = lines.text(0, len(lines.starts))
    try:
        _take(lines, _parse(whole), 0, functions)
        return functions, errors
    except FAILURES:
        functions.clear()
    logical = lines.logical()
    for a, b in _chunks(lines, logical, 0, len(lines.starts), 0):
        _part(lines, logical, a, b, functions, errors, lines.text(a, b) == whole)
    return functions, errors
