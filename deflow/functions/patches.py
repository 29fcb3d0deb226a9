"""Unified diffs and source text as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statements too common to say anything about a change.
TRIVIAL_LINES = ["pass", "return", "else:", "try:", "finally:", "continue", "break"]
MIN_SIGNIFICANT = 8      # fixed value: shorter lines are not significant
MAX_LINES = 300          # fixed value: default length of a truncated file


def lines(text: str) -> str:
    """SQL array of lines; a final line break does not open another line."""
    return f"if({text} = '', cast(array() AS array<string>), split(regexp_replace({text}, r'(\\r\\n|\\n|\\r)\\z', ''), r'\\r\\n|\\n|\\r'))"


def modified_files(patch: str) -> Column:
    """Python files a diff modifies, in order, without deleted ones."""
    return F.expr(f"""array_distinct(transform(filter(transform(array({lines(patch)}), ln -> transform(ln, (x, i) -> struct(x, get(ln, i + 1) AS nxt)))[0],
        p -> startswith(p.x, '--- a/') AND p.x <> '--- a/dev/null' AND endswith(p.x, '.py')
             AND startswith(p.nxt, '+++ b/') AND p.nxt <> '+++ b/dev/null'), p -> substr(p.x, 7)))""")


def significant_sql(patch: str, marker: str) -> str:
    trivial = ", ".join(f"'{t}'" for t in TRIVIAL_LINES)
    body = f"transform(filter({lines(patch)}, x -> startswith(x, '{marker}') AND NOT startswith(x, '{marker * 3}')), x -> regexp_replace(substr(x, 2), r'^\\s+|\\s+$', ''))"
    return f"filter({body}, x -> length(x) >= {MIN_SIGNIFICANT} AND NOT startswith(x, '#') AND x NOT IN ({trivial}))"


def significant_lines(patch: str, marker: str) -> Column:
    """Added (``+``) or removed (``-``) lines that carry meaning."""
    return F.expr(significant_sql(patch, marker))


def patch_coverage(patch: str, output: str) -> Column:
    """Share of significant lines handled: additions present plus removals absent; 0 when there are none."""
    a, r = significant_sql(patch, "+"), significant_sql(patch, "-")
    return F.expr(f"""transform(array(struct({a} AS a, {r} AS r)), p -> coalesce(try_divide(
        cast(size(filter(p.a, x -> contains({output}, x))) + size(filter(p.r, x -> NOT contains({output}, x))) AS double),
        size(p.a) + size(p.r)), 0D))[0]""")


def hunks_sql(patch: str) -> str:
    found = f"filter({lines(patch)}, x -> x rlike r'^@@ -\\d+(,\\d+)? ')"
    first = "cast(regexp_extract(x, r'^@@ -(\\d+)', 1) AS int)"
    count = "if(x rlike r'^@@ -\\d+,', cast(regexp_extract(x, r'^@@ -\\d+,(\\d+)', 1) AS int), 1)"
    return f"transform({found}, x -> struct({first} AS s, {first} + {count} - 1 AS e))"


def hunk_ranges(patch: str) -> Column:
    """Old-side line ranges of the hunks."""
    return F.expr(hunks_sql(patch))


def merged_sql(hunks: str, n_lines: str, context: str) -> str:
    """Ranges padded by ``context``, clipped to the file, overlapping or adjacent ones merged."""
    shape = "array<struct<s:int,e:int>>"
    padded = f"sort_array(transform({hunks}, h -> struct(greatest(1, h.s - {context}) AS s, least({n_lines}, h.e + {context}) AS e)))"
    last = "acc[size(acc) - 1]"
    return f"""aggregate({padded}, cast(array() AS {shape}), (acc, h) ->
        CASE WHEN size(acc) > 0 AND h.s <= {last}.e + 1
             THEN concat(slice(acc, 1, size(acc) - 1), array(struct({last}.s AS s, greatest({last}.e, h.e) AS e)))
             ELSE concat(acc, array(struct(h.s AS s, h.e AS e))) END)"""


def truncate_to_relevant(content: str, patch: str, max_lines: int = MAX_LINES) -> Column:
    """A long file reduced to the surroundings of the diff's hunks, the context halved until it fits.

    Fixed value: the text of the mark where lines are left out.
    """
    let = lambda var, value, body: f"transform(array({value}), {var} -> {body})[0]"
    total = lambda m: f"aggregate({m}, 0, (n, h) -> n + h.e - h.s + 1)"
    merged = lambda c: merged_sql("hk", "size(ln)", c)
    # A context of at most max_lines / 2 reaches 1 after this many halvings.
    halvings = max(max_lines, 10).bit_length() + 1
    context = (f"aggregate(sequence(1, {halvings}), greatest(5, cast(floor({max_lines} / (2 * greatest(1, size(hk)))) AS int)), "
               f"(c, k) -> if(c > 1 AND {total(merged('c'))} > {max_lines}, greatest(1, cast(floor(c / 2) AS int)), c))")
    gap = lambda a, b: f"concat('# ... (lines ', {a}, '–', {b}, ' omitted) ...')"
    piece = "array_join(slice(ln, h.s, greatest(h.e - h.s + 1, 0)), '\\n')"
    pieces = f"""aggregate(mg, named_struct('out', cast(array() AS array<string>), 'prev', 0), (acc, h) -> named_struct(
        'out', concat(acc.out, if(h.s > acc.prev + 1, array({gap('acc.prev + 1', 'h.s - 1')}), cast(array() AS array<string>)), array({piece})), 'prev', h.e),
        acc -> array_join(if(acc.prev < size(ln), concat(acc.out, array({gap('acc.prev + 1', 'size(ln)')})), acc.out), '\\n'))"""
    body = let("hk", hunks_sql(patch), f"if(size(hk) = 0, array_join(slice(ln, 1, {max_lines}), '\\n'), "
               + let("cx", context, let("mg", merged("cx"), pieces)) + ")")
    return F.expr(let("ln", lines(content), f"if(size(ln) <= {max_lines}, {content}, {body})"))


def head_lines(text: str, n: int, mark: str = "… (truncated)") -> Column:
    """The first ``n`` lines, with a mark when more were there."""
    return F.expr(f"transform(array({lines(text)}), ln -> if(size(ln) > {n}, concat(array_join(slice(ln, 1, {n}), '\\n'), '\\n{mark}'), {text}))[0]")


def code_block(text: str) -> Column:
    """Body of the first fenced code block, null when there is none."""
    pattern = r"(?s)```(?:python)?\n(.*?)```"
    return F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, 1))


def byte_to_line(text: str, offset: str) -> Column:
    """1-based line of a byte offset."""
    head = f"decode(substring(cast({text} AS binary), 1, cast(greatest(0, {offset}) AS int)), 'UTF-8')"
    return F.expr(f"length({head}) - length(replace({head}, '\\n', '')) + 1")


def symbol_position(source: str, symbol: str) -> Column:
    """Byte offset of the first whole-word occurrence, null when absent."""
    at = f"regexp_instr({source}, concat('\\\\b', '\\\\Q', {symbol}, '\\\\E', '\\\\b'))"
    return F.expr(f"if({at} > 0, octet_length(substr({source}, 1, {at} - 1)), null)")


def safe_name(path: str) -> Column:
    return F.regexp_replace(path, r"[/\\]", "__")


def percent(rate: Column) -> Column:
    """``12.3%``; undefined rates are ``N/A``."""
    return F.when(rate.isNull() | F.isnan(rate), "N/A").otherwise(F.format_string("%.1f%%", rate * 100))


def first_available(sources: list[str], n: int) -> Column:
    """The first source that is neither null nor empty, cut to its first ``n`` lines; null when there is none."""
    return F.when(F.coalesce(*[F.nullif(F.col(s), F.lit("")) for s in sources]).isNotNull(),
                  head_lines("coalesce(" + ", ".join(f"nullif({s}, '')" for s in sources) + ")", n))
