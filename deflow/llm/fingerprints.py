"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs are its lines, longer lines in pieces of ``PIECE`` code points; their distinct 64-bit
digests are its set. A sketch has three rows of cells; a digest goes into one cell of each row, where
count, digests (xor) and check hashes (xor) add up. The sketch of ``3 * WIDTH`` cells, as text, is the
fingerprint.

Two versions are compared by subtracting their cells. What both have cancels; a cell left with one digest
shows it, which is taken out of its other cells, and so on, until nothing is left and all differing digests
are known. Where that fails, a larger sketch is tried: the digests are dealt to pages, about ``PAGE`` of both
texts each, every page has a sketch of its own, and one that cannot be emptied is built anew with wider
rows, up to the last width; a page that resists even that is listed digest by digest. So the work grows in proportion to the
text, and the likeness, shared digests over all, is exact but for equal hashes.

Defined results: a null text is an empty one and has no paragraph; two such are alike (1.0). Repeated
paragraphs count once. Rows that repeat are documents of their own; equal keys are ordered by a hash of the
text; null keys come last. In a table of one row, the next document is the document itself. Clashing
column names do not matter, as only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 128
WIDTH = 6               # cells in a row of the fingerprint
PAGE = 6                # digests of both texts on a page
WIDTHS = (6, 12, 48)    # cells in a row of a page's sketch: the first try and the larger ones
BLOCK_BITS = 10         # keys that differ in these low bits only lie in one block
FEW = 10_000            # blocks whose order one task may find


def paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs, each once."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{PIECE}}}\\n?|\\n"), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spot(digest: str, cell: str, w: int) -> str:
    """Whether ``digest`` belongs into ``cell``: row r looks at the digest from its 20 r-th bit on."""
    return f"pmod(shiftrightunsigned({digest}, 20 * ({cell} div {w})), {w}) = {cell} % {w}"


def cells(digests: str, w: int) -> str:
    """The sketch of an array of digests: for each cell count n, digests k, checks q."""
    return (f"transform(sequence(0L, {3 * w - 1}L), c -> aggregate(filter({digests}, d -> {_spot('d', 'c', w)}), "
            "named_struct('n', 0, 'k', 0L, 'q', 0L), (a, d) -> named_struct('n', a.n + 1, 'k', a.k ^ d, 'q', a.q ^ xxhash64(d))))")


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'q', x.q ^ y.q))"


def peeled(sketch: str, w: int) -> str:
    """The digests that empty a subtracted sketch, with n = 1 or -1 for the side that has them; null where it fails."""
    pure = "filter(s.cells, x -> abs(x.n) = 1 AND xxhash64(x.k) = x.q)"
    out = (f"transform(t.cells, (x, c) -> if({_spot('p.k', 'c', w)}, named_struct('n', x.n - p.n, 'k', x.k ^ p.k, 'q', x.q ^ p.q), x))")
    step = (f"if(s.stuck, s, aggregate(slice({pure}, 1, 1), named_struct('cells', s.cells, 'got', s.got, 'stuck', true), "
            f"(t, p) -> named_struct('cells', {out}, 'got', concat(t.got, array(named_struct('n', p.n, 'k', p.k))), 'stuck', false)))")
    empty = "cast(array() AS array<struct<n:int,k:bigint>>)"
    return (f"aggregate(sequence(1, {3 * w}), named_struct('cells', {sketch}, 'got', {empty}, 'stuck', false), (s, i) -> {step}, "
            "s -> if(exists(s.cells, x -> x.n != 0 OR x.k != 0 OR x.q != 0), null, s.got))")


def _page(run: str) -> str:
    """The differing digests of one page: entries (page, d, side), sketched wider and wider."""
    tries = []
    for w in WIDTHS:
        side = lambda s: cells(f"transform(filter({run}, e -> e.side = {s}), e -> e.d)", w)
        tries.append(peeled(subtracted(side(1), side(-1)), w))
    listed = f"transform(filter({run}, e -> size(filter({run}, f -> f.d = e.d)) = 1), e -> named_struct('n', e.side, 'k', e.d))"
    return f"coalesce({', '.join(tries)}, {listed})"


def differing(a: str, b: str) -> str:
    """SQL: array of (n, k) for the digests that only array ``a`` (n = 1) or only ``b`` (n = -1) has."""
    base = f"if(abs(size({a}) - size({b})) > {3 * WIDTH}, null, {peeled(subtracted(cells(a, WIDTH), cells(b, WIDTH)), WIDTH)})"
    pages = f"shiftleft(1L, cast(ceil(log2(1 + (size({a}) + size({b})) / {PAGE})) AS int))"
    signed = lambda x, s: f"transform({x}, d -> named_struct('page', shiftrightunsigned(d, 4) & (pages - 1), 'd', d, 'side', {s}))"
    entries = f"sort_array(concat({signed(a, 1)}, {signed(b, -1)}))"
    starts = "filter(sequence(1, size(s)), i -> i = 1 OR element_at(s, i).page != element_at(s, i - 1).page)"
    runs = "transform(at, (b0, i) -> slice(s, b0, coalesce(get(at, i + 1), size(s) + 1) - b0))"
    larger = _bound(pages, "pages", _bound(entries, "s", _bound(starts, "at", f"flatten(transform({runs}, r -> {_page('r')}))")))
    return f"if(size({a}) + size({b}) = 0, cast(array() AS array<struct<n:int,k:bigint>>), coalesce({base}, {larger}))"


def likeness(a: str, b: str) -> Column:
    """Shared digests over all digests of the columns ``a`` and ``b``, by way of the differing ones."""
    d = f"size({differing(a, b)})"
    return F.expr(_bound(d, "diff", f"if(size({a}) + size({b}) = 0, 1D, (size({a}) + size({b}) - diff) / (size({a}) + size({b}) + diff))"))


def fingerprint(digests: str) -> Column:
    """The sketch as text: number of digests, then count, digests and checks of each cell."""
    return F.expr(f"concat(size({digests}), ':', array_join(transform({cells(digests, WIDTH)}, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.q))), ' '))")


def followers(ids: DataFrame) -> DataFrame:
    """id, next: for distinct ``id`` the largest smaller one; the largest of all for the smallest.

    Ids are ordered inside blocks of 2 ** 16 neighbours; block ends look at the blocks in the same way, until few are left.
    """
    down = F.col("id").desc()
    if ids.limit(FEW + 1).count() <= FEW:
        return ids.select("id", F.coalesce(F.lead("id").over(Window.orderBy(down)), F.max("id").over(Window.partitionBy())).alias("next"))
    blocked = ids.withColumn("block", F.shiftright("id", 16))
    inside = blocked.withColumn("next", F.lead("id").over(Window.partitionBy("block").orderBy(down)))
    tops = blocked.groupBy("block").agg(F.max("id").alias("top"))
    jump = followers(tops.select(F.col("block").alias("id"))).select(F.col("id").alias("block"), F.col("next").alias("to"))
    jump = jump.join(tops.select(F.col("block").alias("to"), "top"), "to").select("block", "top")
    return inside.join(jump, "block").select("id", F.coalesce("next", "top").alias("next"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (id, tie and ``columns``) with ``next_`` columns: those of the next row by descending id, in a circle.

    A block has at most 2 ** BLOCK_BITS different ids, whatever their number, so one shuffle brings rows and
    their next ones together; only the last row of a block gets the first one of the next block by a join.
    """
    blocked = rows.withColumn("block", F.shiftright("id", BLOCK_BITS))
    order = Window.partitionBy("block").orderBy(F.col("id").desc(), "tie")
    led = blocked.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns],
                         F.lead(F.lit(False), 1, True).over(order).alias("last"), F.row_number().over(order).alias("place"))
    blocks = followers(rows.select(F.shiftright("id", BLOCK_BITS).alias("id")).distinct())
    firsts = led.where("place = 1").select(F.col("block").alias("next"), *[F.col(c).alias(f"first_{c}") for c in columns])
    firsts = blocks.join(firsts, "next").select(F.col("id").alias("block_"), *[f"first_{c}" for c in columns])
    joined = led.join(firsts, (led["block"] == firsts["block_"]) & led["last"], "left")
    return joined.select(*rows.columns, *[F.when(F.col("last"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64("text").alias("tie"), "text", paragraphs(F.col("text")).alias("own"))
    paired = with_next(rows, ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    paired = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    paired = paired.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("new"))
    return paired.select("doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("new").alias("edited_fingerprint"),
                         likeness("own", "new").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
