"""Merkle manifest of a table: sixteen-ary hash trees, one per group, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a group, ascending by key, are
hashed in runs of ``FANOUT`` until one node is left, the group's root; the groups' roots, ordered by group,
are hashed likewise into the root of the table.

**Midstates.** A parent keeps a copy of its hash state from before each child slot (``Parent``). To fold a
changed child upward, the state before its slot is resumed with the replacement and the siblings to its
right only; what stands left of it is never hashed again.

**Scale.** Equal rows are counted as one, sorted by range, and numbered by a running sum inside each range and one over the
ranges. ``STEP`` levels are built at a time over chunks of ``FANOUT ** STEP`` consecutive nodes, so a group that
holds most of the rows is as many chunks as it has nodes to hash, and no task sees more than a chunk at once.
Roots of chunks are the nodes of the next round; their number falls by 256 each time. On the way down a
chunk's path (left and right siblings of each level above) meets its nodes once, and its states are shared by all.

Defined results: a null field is ``-``. A null group is a group of its own, before all others; null keys come
before all others, and rows of one key are ordered by leaf. A row without any sibling has the hash of nothing
as its proof. An empty table has no root and no row. Fields are read by name alone, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deflow.llm import common

FANOUT, BITS = 16, 4
STEP = 2                    # levels built at a time
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """An inner node with the hash states before each of its children."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.states = children, []
        for c in children:
            self.states.append(state.copy())
            state.update(c)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, child: bytes) -> bytes:
        """The node's digest if ``child`` stood in ``slot``."""
        return resumed(self.states[slot], child, b"".join(self.children[slot + 1:]))

    def sides(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1:])


def resumed(state, child: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(child)
    state.update(right)
    return state.hexdigest().encode()


class Subtree:
    """``levels`` levels of parents above consecutive nodes."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.parents: list[list[Parent]] = []
        for _ in range(levels):
            self.parents.append([Parent(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
            nodes = [p.digest for p in self.parents[-1]]
        self.nodes = nodes

    def above(self, i: int) -> Iterator[tuple[Parent, int]]:
        """The parents of node i with the slot on the way to it, bottom up."""
        for level in self.parents:
            yield level[i // FANOUT], i % FANOUT
            i //= FANOUT


def entry(value: Column) -> Column:
    """A field with its length in bytes, or ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[entry(f) for f in fields]).cast("binary"), 256)


def leaves(docs: DataFrame, key: str = "doc_id", by: str = "source", fields: tuple[str, ...] = FIELDS,
           changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """g (group, never null), k, leaf, other (the leaf with ``changed`` columns ``where`` that holds, else null), n (equal rows)."""
    plain = leaf([docs[f] for f in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = leaf([changed.get(f, docs[f]) for f in fields])
        other = other if where is None else F.when(where, other)
    group = F.when(docs[by].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[by].cast("string")))
    own = docs.select(group.alias("g"), docs[key].cast("long").alias("k"), plain.alias("leaf"), other.alias("other"))
    own = own.select("g", "k", F.unhex("leaf").alias("leaf"), F.unhex("other").alias("other"))
    return own.groupBy("g", "k", "leaf", "other").agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (g, k, leaf, n, ...) with pos (of the first of n equal ones in its group) and depth (of the group's tree).

    Rows lie in ranges of (g, k, leaf), frozen in a table; a running sum inside each range is shifted by one over the ranges.
    """
    order = [F.col("k").asc_nulls_first(), F.col("leaf")]
    ranged = common.written(rows.repartitionByRange(F.col("g"), *order).withColumn("part", F.spark_partition_id()), name)
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row for each range
    sums = sums.select("g", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy("g")).alias("all"))
    inside = Window.partitionBy("g", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["g", "part"])
    depth = F.when(F.col("all") > 1, F.length(F.hex(F.col("all") - 1))).otherwise(0)      # digits of the last place to base 16
    return own.select(*rows.columns, (F.col("base") + F.col("own")).alias("pos"), depth.cast("int").alias("depth"))


def _dealt(nodes: DataFrame, *keep: str) -> DataFrame:
    """A row for each chunk that a node (or its repetitions) touches: g, chunk, at (place in it), m (repetitions there)."""
    size = STEP * BITS
    out = nodes.withColumn("chunk", F.explode(F.sequence(F.shiftright("pos", size), F.shiftright(F.col("pos") + F.col("n") - 1, size))))
    low = F.greatest(F.col("pos"), F.shiftleft("chunk", size))
    high = F.least(F.col("pos") + F.col("n"), F.shiftleft(F.col("chunk") + 1, size))
    return out.select("g", "chunk", (low - F.shiftleft("chunk", size)).cast("int").alias("at"), (high - low).cast("int").alias("m"), "depth", "leaf", *keep)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """The rows of each chunk of a sorted partition."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["g"], r["chunk"]) != now:
                if held:
                    yield now, held
                now, held = (r["g"], r["chunk"]), []
            held.append(r)
    if held:
        yield now, held


def _hexed(rows: list[dict]) -> list[bytes]:
    return [x for r in rows for x in [r["leaf"].hex().encode()] * r["m"]]


def _sorted(df: DataFrame) -> DataFrame:
    return common.on_workers(df).repartition("g", "chunk").sortWithinPartitions("g", "chunk", "at")


def raised(nodes: DataFrame, done: int) -> DataFrame:
    """The roots of the chunks of ``nodes``, which stand ``done`` levels above the leaves: g, pos, depth, leaf (their digest), n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, chunk), rows in _chunks(batches):
            depth = rows[0]["depth"]
            (top,) = Subtree(_hexed(rows), min(STEP, depth - done)).nodes
            yield pa.RecordBatch.from_pylist([{"g": g, "pos": chunk, "depth": depth, "leaf": bytes.fromhex(top.decode()), "n": 1}], shape)

    schema = "g string, pos long, depth int, leaf binary, n long"
    shape = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("depth", pa.int32()), ("leaf", pa.binary()), ("n", pa.int64())])
    return _sorted(_dealt(nodes.where(F.col("depth") > done))).mapInArrow(run, schema)


PATH = "path array<struct<left:binary,right:binary>>, top binary, root binary"


@dataclass
class Tree:
    """Nodes of all groups: ``rounds[i]`` stand ``i * STEP`` levels above the leaves."""

    rounds: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def over(rows: DataFrame, name: str) -> Tree:
        tree = Tree([common.written(numbered(rows, f"{name}-ranges"), f"{name}-leaves")])
        deepest = tree.rounds[0].agg(F.max("depth")).first()[0] or 0
        for done in range(0, deepest, STEP):
            tree.rounds.append(common.written(raised(tree.rounds[-1], done), f"{name}-nodes"))
        return tree

    def tops(self) -> DataFrame:
        """g and the digest of its root."""
        out = None
        for i, nodes in enumerate(self.rounds):
            low = -1 if i == 0 else (i - 1) * STEP
            top = nodes.where((F.col("depth") <= i * STEP) & (F.col("depth") > low)).select("g", "leaf")
            out = top if out is None else out.unionByName(top)
        return out

    def _met(self, i: int, above: DataFrame, tops: DataFrame, *keep: str) -> DataFrame:
        """Nodes of round i in chunks, each behind a row (at -1) with the path of its chunk: from the round
        above, or from the group where its tree ends here."""
        nodes = _dealt(self.rounds[i], *keep)
        paths = above if above is not None else tops.limit(0).withColumn("chunk", F.lit(0).cast("long"))
        ended = self.rounds[i].where(F.col("depth") <= i * STEP).select("g").distinct()
        paths = paths.unionByName(tops.join(ended, "g").withColumn("chunk", F.lit(0).cast("long")))
        return _sorted(nodes.unionByName(paths.withColumn("at", F.lit(-1)), allowMissingColumns=True))

    def paths(self, tops: DataFrame, name: str) -> DataFrame | None:
        """g, chunk and the path of each chunk of leaves that has parents above it; ``tops`` has the paths of the groups' roots."""
        above = None
        for i in range(len(self.rounds) - 1, 0, -1):
            def run(batches: Iterator[pa.RecordBatch], done: int = i * STEP) -> Iterator[pa.RecordBatch]:
                for (g, chunk), (head, *rows) in _chunks(batches):
                    tree = Subtree(_hexed(rows), max(0, min(STEP, rows[0]["depth"] - done)))
                    for n in range(len(rows)):
                        own = [dict(zip(("left", "right"), p.sides(slot))) for p, slot in tree.above(n)]
                        yield pa.RecordBatch.from_pylist([{
                            "g": g, "chunk": (chunk << STEP * BITS) + rows[n]["at"], "path": own + head["path"], "top": head["top"], "root": head["root"]}], shape)

            shape = common.arrow_schema(tops.withColumn("chunk", F.lit(0).cast("long")).select("g", "chunk", "path", "top", "root").schema)
            above = common.written(self._met(i, above, tops).mapInArrow(run, f"g string, chunk long, {PATH}"), f"{name}-paths")
        return above


@dataclass
class Manifest:
    """The trees of a table: over the rows of each group, and over the groups' roots."""

    rows: Tree
    groups: Tree

    def group_paths(self) -> DataFrame | None:
        """g with the path of its root in the tree of groups, its digest and the table's root."""
        root = self.groups.tops().select(F.lit("").alias("g"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"),
                                         F.col("leaf").alias("top"), F.col("leaf").alias("root"))
        above = self.groups.paths(root, "groups")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (head, *rows) in _chunks(batches):
                tree = Subtree(_hexed(rows), min(STEP, rows[0]["depth"]))
                for n, r in enumerate(rows):
                    own = [dict(zip(("left", "right"), p.sides(slot))) for p, slot in tree.above(n)]
                    yield pa.RecordBatch.from_pylist([{"g": r["k"], "path": own + head["path"], "top": r["leaf"], "root": head["root"]}], shape)

        shape = common.arrow_schema(root.schema)
        return common.written(self.groups._met(0, above, root, "k").mapInArrow(run, f"g string, {PATH}"), "group-paths")

    def proofs(self) -> DataFrame:
        """One row per row of the table: k, leaf, subroot, root, proof_sha256, folded_root (from the changed leaf where
        there is one), all but k as lower-case hex."""
        tops = self.group_paths()
        above = self.rows.paths(tops, "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, (head, *rows) in _chunks(batches):
                tree = Subtree(_hexed(rows), min(STEP, rows[0]["depth"]))
                upper = [(hashlib.sha256(p["left"]), p["right"]) for p in head["path"]]
                beside = b"".join(p["left"] + p["right"] for p in head["path"])
                out, n = [], 0
                for r in rows:
                    own, other = r["leaf"].hex(), (r["other"] or r["leaf"]).hex().encode()
                    for n in range(n, n + r["m"]):
                        near, now = b"", other
                        for p, slot in tree.above(n):
                            near += b"".join(p.sides(slot))
                            now = p.folded(slot, now)
                        for state, right in upper:
                            now = resumed(state, now, right)
                        out.append((r["k"], own, head["top"].hex(), head["root"].hex(), hashlib.sha256(near + beside).hexdigest(), now.decode()))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] + [pa.string()] * 5)], names=names)

        names = ["k", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        met = self.rows._met(0, above, tops, "k", "other")
        return met.mapInArrow(run, "k long, " + ", ".join(f"{n} string" for n in names[1:]))


def build(rows: DataFrame) -> Manifest:
    """The manifest of ``leaves``; its tables lie in the shared folder."""
    tree = Tree.over(rows, "rows")
    tops = tree.tops().select(F.lit("").alias("g"), F.col("g").alias("k"), "leaf", F.lit(1).cast("long").alias("n"))
    return Manifest(tree, Tree.over(tops, "groups"))


def tampered(key: Column, every: int = 5) -> Column:
    """Whether ``every`` divides the unsigned crc32 of the key's decimal digits; never for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % every == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def verify(docs: DataFrame, key: str = "doc_id", text: str = "text", by: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The proofs of all rows, folded with the text's A-Z in lower case for a fifth of the keys; verified is whether the root results."""
    rows = leaves(docs, key, by, fields, {text: lowered(docs[text])}, tampered(docs[key]))
    return build(rows).proofs().withColumnRenamed("k", key).withColumn("verified", F.col("folded_root") == F.col("root"))
