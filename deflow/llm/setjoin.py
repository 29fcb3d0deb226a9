"""Exact n-gram Jaccard join of documents by inverted lists, position skips and derived answers.

A document's set holds the hashes of its distinct runs of five words. Equal sets are one class from the
start. Two sets are linked when ``100 * common >= 80 * union``.

1. **Lists.** Hashes are sent, packed and sorted, to buckets. There, those that only one set has drop out;
   the others go back to their sets with the number of sets that have them. A hash that is common already
   within one task's share is not sent set by set: the task says so to the bucket and answers its own sets
   itself, so no hash fills a bucket, and all agree that this hash is hot.
2. **Prefixes.** A set's hashes are ordered from rare to frequent (unique ones first, hot ones last). A partner
   must share one of the first ``n - ceil(0.8 n) + 1``; a set whose prefix is unique throughout has no
   partner and leaves here. What is common to two sets is never unique, so the shared hashes alone are
   enough to compare them exactly.
3. **Skips.** In a list, entries fall into blocks of equal set size and position. Two blocks are passed over
   when the smaller remainder behind their positions cannot hold the required overlap.
4. **Derived answers.** Each set is first compared with a few entries only, which most of its lists choose alike. What a set has in common
   with that one bounds its overlap with every other entry of the list, from either side; pairs so decided,
   and pairs that are already connected, are not compared. The pairs left are compared exactly, all of
   them, so no link between components is lost. Nothing is emitted for all pairs of a group of copies.

Defined results: a null or empty text has an empty set, no link and its own key as component. A text of
fewer than five words has its whole sequence as its one element. Rows that repeat a text are members of one
class; a row's own text decides, so rows of one key with different texts can be in different components. A
null key can belong to a component but never names it, unless all its keys are null.
Sets and elements are identified by 64-bit hashes. Clashing column names do not matter, as only key and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deflow.llm import common
from deflow.llm.components import components
from deflow.llm.words import portions, split

WIDTH = 5
PART, WHOLE = 80, 100       # linked when WHOLE * common >= PART * union
FLUSH = 1_000_000           # elements a task packs at a time: about 40 MB while it sorts
BUCKET = 1_500_000          # elements of a bucket
LOCAL_HOT = 64              # sets of one packing that make an element hot
HOT = np.uint32(0xFFFFFFFF)
ROUNDS = 2                  # of comparing each set with a few others before the exhaustive comparison
PARTNERS = 3                # others in each round, besides the plainest one


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of size n with any partner."""
    return (PART * n + WHOLE - 1) // WHOLE


# ---- packed arrays: byte planes, so that equal high bytes lie together and compress

def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", 2 * count, 4).reshape(count, 2).tolist()
    at, out = 4 + 8 * count, []
    for n, width in sizes:
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


def sets_of(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct elements of each text."""
    for a, b in portions(texts):
        h, text = split(texts[a:b]).shingles(WIDTH)
        at = np.searchsorted(text, np.arange(b - a + 1))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(h[x:y])


def name_of(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes())


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut_by(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of each run in sorted ``bucket``."""
    if len(bucket):
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)]):
            yield int(bucket[a]), a, b


def replies(ref: np.ndarray, n: np.ndarray, h: np.ndarray, df: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket of the sets, packed answers) of parallel arrays of set, its size, element and frequency."""
    order = np.lexsort((h, ref))
    ref, n, h, df = ref[order], n[order], h[order], df[order]
    for k, a, b in cut_by(bucket_of(ref, buckets)):
        first = np.flatnonzero(np.concatenate([[True], ref[a + 1:b] != ref[a:b - 1]]))
        yield k, pack(ref[a:b][first], n[a:b][first], np.diff(np.append(first, b - a)).astype("<u4"), h[a:b], df[a:b])


def unpack_replies(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ref, n, count, h, df = unpack(data)
    return np.repeat(ref, count), np.repeat(n, count), h, df


class Packer:
    """Collects sets of one task and packs their elements for the buckets."""

    def __init__(self, buckets: int, salt: int):
        self.buckets, self.salt = buckets, salt
        self.clear()

    def clear(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, elements: np.ndarray) -> None:
        ref = name_of(elements)
        if ref not in self.sets:
            self.sets[ref] = elements
            self.held += len(elements)

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, -1, postings), or (any bucket, bucket of the sets, answers) for what is hot here."""
        ref = np.fromiter(self.sets, np.uint64, len(self.sets))
        size = np.array([len(s) for s in self.sets.values()], np.int64)
        h = np.concatenate([*self.sets.values(), np.zeros(0, np.uint64)])
        self.clear()
        who = np.repeat(np.arange(len(ref), dtype="<u4"), size)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        hot = count >= LOCAL_HOT
        is_hot = np.repeat(hot, count)
        marks = h[first[hot]]
        direct = who[is_hot]
        for k, blob in replies(ref[direct], size[direct].astype("<u4"), h[is_hot], np.full(len(direct), HOT, "<u4"), self.buckets):
            self.salt += 1
            yield self.salt % self.buckets, k, blob
        h, who = h[~is_hot], who[~is_hot]
        mark_bucket = bucket_of(marks, self.buckets)
        for k, a, b in cut_by(bucket_of(h, self.buckets)):
            own, index = np.unique(who[a:b], return_inverse=True)
            yield k, -1, pack(ref[own], size[own].astype("<u4"), np.diff(h[a:b], prepend=np.uint64(0)), index.astype("<u2" if len(own) < 1 << 16 else "<u4"), marks[mark_bucket == k])
        empty = np.zeros(0, np.uint64)
        for k in np.setdiff1d(mark_bucket, bucket_of(h, self.buckets)).tolist():
            yield k, -1, pack(empty, np.zeros(0, "<u4"), empty, np.zeros(0, "<u2"), marks[mark_bucket == k])


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, mark (hash of the text), ref (name of the set, null for an empty one), n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, 0) if not len(s) else (np.uint64(name_of(s)).view(np.int64).item(), len(s)) for s in sets_of(common.utf8(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["k", "mark", "ref", "n"])
        common.release()

    own = common.on_workers(docs).select(docs[key].cast("long").alias("k"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("t"))
    return own.mapInArrow(run, "k long, mark long, ref long, n long")


def shared_elements(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """The sets that can have a partner: ref, n, s (shared elements), elements (sorted), head (prefix, rare first)."""
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "target", "blob"], [pa.int32(), pa.int32(), pa.binary()]
        packer = Packer(buckets, 0)
        for b in batches:
            for s in sets_of(common.utf8(b.column(0))):
                if len(s):
                    packer.add(s)
                if packer.held >= FLUSH:
                    for row in packer.flush():
                        yield _rows([row], names, types)
        for row in packer.flush():
            yield _rows([row], names, types)
        common.release()

    def answered(t: pa.Table) -> pa.Table:
        out, refs, sizes, hs, marks = [], [], [], [], []
        for target, blob in zip(t.column("target").to_pylist(), t.column("blob").to_pylist()):
            if target >= 0:
                out.append((target, blob))
                continue
            ref, size, gaps, index, mark = unpack(blob)
            refs.append(ref[index]), sizes.append(size[index]), hs.append(np.cumsum(gaps, dtype=np.uint64)), marks.append(mark)
        if marks:
            ref, size, h = np.concatenate(refs), np.concatenate(sizes), np.concatenate(hs)
            del refs, sizes, hs
            order = np.lexsort((ref, h))
            ref, size, h = ref[order], size[order], h[order]
            if len(h):
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (ref[1:] != ref[:-1])])
                ref, size, h = ref[new], size[new], h[new]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                count = np.diff(np.append(first, len(h)))
                df = np.where(np.isin(h[first], np.concatenate(marks)), HOT, count).astype("<u4")
                df = np.repeat(df, count)
                keep = df > 1
                out += replies(ref[keep], size[keep], h[keep], df[keep], buckets)
                del df, keep, new, first, count
            del ref, size, h, order, marks
            common.release()
        return pa.table({"target": pa.array([o[0] for o in out], pa.int32()), "blob": pa.array([o[1] for o in out], pa.binary())})

    def gathered(t: pa.Table) -> pa.Table:
        parts = [unpack_replies(b) for b in t.column("blob").to_pylist()]
        ref, n, h, df = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((h, df, ref))
        ref, n, h, df = ref[order], n[order], h[order], df[order]
        new = np.concatenate([[True], (ref[1:] != ref[:-1]) | (h[1:] != h[:-1])])
        ref, n, h = ref[new], n[new].astype(np.int64), h[new]
        first = np.flatnonzero(np.concatenate([[True], ref[1:] != ref[:-1]]))
        s = np.diff(np.append(first, len(ref)))
        size = n[first]
        head = size - needed(size) + 1 - (size - s)
        rows = [(first[i], s[i], head[i], size[i]) for i in np.flatnonzero(head > 0).tolist()]
        return pa.table({
            "ref": pa.array([ref[a] for a, *_ in rows], pa.uint64()).view(pa.int64()), "n": pa.array([r[3] for r in rows], pa.int64()),
            "s": pa.array([r[1] for r in rows], pa.int64()), "elements": pa.array([np.sort(h[a:a + c]).tobytes() for a, c, _, _ in rows], pa.binary()),
            "head": pa.array([h[a:a + q].tobytes() for a, _, q, _ in rows], pa.binary())})

    posts = common.on_workers(docs).select(docs[text]).mapInArrow(posted, "bucket int, target int, blob binary")
    answers = posts.groupBy("bucket").applyInArrow(answered, "target int, blob binary")
    return answers.groupBy("target").applyInArrow(gathered, "ref long, n long, s long, elements binary, head binary")


def entries(sets: DataFrame) -> DataFrame:
    """h, ref, n, rest, plain: the list entries of all prefixes; ``rest`` elements stand at or behind the entry's position.

    ``plain`` is the share of the set's elements that other sets have: of a family of edited copies, the
    original has the highest, and is alike to more of them than any other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            count = [len(x) for x in heads]
            at = pa.array(np.repeat(np.arange(len(count)), count))
            place = np.concatenate([np.arange(c) for c in count] + [np.zeros(0, np.int64)])
            s = b.column(2).take(at).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(heads + [np.zeros(0, np.int64)])), b.column(0).take(at), b.column(1).take(at), pa.array(s - place),
                 pa.array(s / b.column(1).take(at).to_numpy(zero_copy_only=False))], names=["h", "ref", "n", "rest", "plain"])

    lists = common.on_workers(sets).select("ref", "n", "s", "head").mapInArrow(run, "h long, ref long, n long, rest long, plain double")
    return lists


def _least(a: str, b: str) -> str:
    """SQL: the overlap that sets of sizes a and b need."""
    return f"({PART} * ({a} + {b}) + {PART + WHOLE - 1}) div {PART + WHOLE}"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b with their sizes and common elements."""
    x = sets.select(F.col("ref").alias("a"), F.col("n").alias("an"), F.col("elements").alias("ae"))
    y = sets.select(F.col("ref").alias("b"), F.col("n").alias("bn"), F.col("elements").alias("be"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches_of(batches, 256):
            both = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                    for p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield common.carry(b, ["a", "b", "an", "bn"], common=pa.array(both, pa.int64()))
        common.release()

    return common.on_workers(pairs).join(x, "a").join(y, "b").select("a", "b", "an", "bn", "ae", "be").mapInArrow(run, "a long, b long, an long, bn long, common long")


LINKED = f"{WHOLE} * common >= {PART} * (an + bn - common)"


def classes(sets: DataFrame) -> DataFrame:
    """ref, root: the connected components of sets that are linked to another."""
    spark = sets.sparkSession
    lists = entries(sets)
    often = lists.groupBy("h").count().where("count > 1").select("h")
    lists = common.written(lists.join(often, "h"), "lists")
    roots = spark.createDataFrame([], "node long, root long")
    links, answers = None, None
    for turn in range(ROUNDS):
        now = _rooted(lists, roots)
        mark = F.xxhash64("ref", F.lit(turn))
        slot = F.explode(F.array(F.lit(0), F.pmod(mark, F.lit(PARTNERS)).cast("int") + 1)).alias("slot")
        weight = F.when(F.col("slot") == 0, F.col("plain")).otherwise(0)
        middle = now.select("*", slot).groupBy("h", "slot").agg(F.max_by(F.struct("ref", "n", "rest", "root", "plain"), F.struct(weight, mark)).alias("c"))
        pairs = now.join(middle, "h").where(f"root != c.root AND {_least('n', 'c.n')} <= least(rest, c.rest)")
        rank = F.struct(F.when(F.col("slot") == 0, F.col("c.plain")).otherwise(0), F.xxhash64("c.ref", F.lit(turn)))
        few = pairs.groupBy("ref", "slot").agg(F.max_by("c.ref", rank).alias("a"))     # most of its lists agree on it
        few = few.select(F.least("a", "ref").alias("a"), F.greatest("a", "ref").alias("b")).distinct()
        found = common.written(compared(few, sets), "compared")
        both = found.select(F.col("a").alias("c"), F.col("b").alias("ref"), F.col("common").alias("got")).unionByName(
            found.select(F.col("b").alias("c"), F.col("a").alias("ref"), F.col("common").alias("got")))
        answers = middle.where("slot = 0").select("h", F.col("c.ref").alias("c")), both
        new = found.where(LINKED).select("a", "b")
        links = new if links is None else links.unionByName(new)
        roots = components(links)
    now = _rooted(lists, roots)
    open_ = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    middle, got = answers
    known = middle.join(open_, "h").join(got, "c").select("h", "ref", "got")
    now = common.written(now.join(open_, "h").join(known, ["h", "ref"], "left"), "open")
    blocks = now.groupBy("h", "n", "rest").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    one, two = (blocks.select("h", *[F.col(c).alias(f"{c}{i}") for c in ("n", "rest", "lo", "hi")]) for i in (1, 2))
    near = one.join(two, "h").where(
        f"(n1 < n2 OR n1 = n2 AND rest1 <= rest2) AND {_least('n1', 'n2')} <= least(rest1, rest2) AND NOT (lo1 = hi1 AND lo2 = hi2 AND lo1 = lo2)")
    one, two = (now.select("h", *[F.col(c).alias(f"{c}{i}") for c in ("n", "rest", "ref", "root", "got")]) for i in (1, 2))
    most = "least(got1, got2) + least(n1 - got1, n2 - got2)"    # what two sets can share, from what each shares with a third
    pairs = near.drop("lo1", "hi1", "lo2", "hi2").join(one, ["h", "n1", "rest1"]).join(two, ["h", "n2", "rest2"]).where(
        f"root1 != root2 AND (got1 IS NULL OR got2 IS NULL OR {most} >= {_least('n1', 'n2')})")
    pairs = pairs.select(F.least("ref1", "ref2").alias("a"), F.greatest("ref1", "ref2").alias("b")).distinct()
    late = compared(pairs, sets).where(LINKED).select("a", "b")
    for c in ("a", "b"):    # between components: a link of theirs is needed once
        late = late.join(roots, late[c] == roots["node"], "left").withColumn(c, F.coalesce("root", c)).select("a", "b")
    return components(links.unionByName(late.distinct())).withColumnRenamed("node", "ref")


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    return lists.join(roots, lists["ref"] == roots["node"], "left").select("h", "ref", "n", "rest", "plain", F.coalesce("root", "ref").alias("root"))


def _first(own: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """ref, least: the least of each set's component, over the rows of all its sets."""
    first = own.where("ref IS NOT NULL").groupBy("ref").agg(F.min(least).alias("low")).join(roots, "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    lows = first.groupBy("root").agg(F.min("low").alias("least"))
    return first.join(lows, "root").select("ref", "least")


def _linked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets, and the roots of linked sets."""
    own = common.written(members(docs, key, text), "members")
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, -(-int(total) // BUCKET))
    return own, classes(common.written(shared_elements(docs, text, buckets), "sets"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    own, roots = _linked(docs, key, text)
    out = own.join(_first(own, roots, F.col("k")), "ref", "left")
    return out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "k").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component: the one with the smallest key, then text hash, null keys last.

    Rows are told apart by key and text hash; of rows that are equal in both, the one whose other columns are
    smallest stays. Texts without words are alike to nothing, and all their rows stay.
    """
    own, roots = _linked(docs, key, text)
    row = F.struct(F.col("k").isNull().alias("no_key"), "k", "mark")
    alike = own.where("ref IS NOT NULL").groupBy("ref", "k", "mark").agg(F.count(F.lit(1)).alias("rows"))
    judged = alike.join(_first(alike, roots, row), "ref").select("k", "mark", (row == F.col("least")).alias("stays"), "rows")
    judged = common.written(judged.where("NOT stays OR rows > 1"), "judged")
    same = lambda j: docs[key].cast("long").eqNullSafe(j["k"]) & (F.xxhash64(docs[text]) == j["mark"])
    out = docs.join(judged, same(judged), "left_anti")
    again = judged.where("stays")
    if again.isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.join(again, same(again), "left_semi").toDF(*names)
    at, by = (names[docs.columns.index(c)] for c in (text, key))
    # A minimum is combined map-side, so rows that repeat very often meet as one for each task.
    one = rows.groupBy(F.col(by).cast("long").alias("k"), F.xxhash64(at).alias("mark")).agg(F.min(F.struct(*names)).alias("least"))
    return out.unionByName(one.select("least.*").toDF(*docs.columns))
