"""Benchmark decontamination by greedy string tiling.

Benchmark items are read in blocks of at most ``BLOCK_WORDS`` words, each held by every task; the documents
stream past once per block, so neither side has a size limit. In a batch of documents:

1. running Karp-Rabin hashes of ``SEED`` words are looked up among the block's (one sorted array);
2. the seeds a document shares with an item lie on diagonals; neighbours on one make a match;
3. the longest match whose words are free is marked, others are cut to their free parts, and so on until
   no match of ``SEED`` words is left: the tiles. Their order does not matter, so passages whose parts were
   moved around are covered as well;
4. the item counts as contained when tiles cover at least ``COVERAGE`` of its words.

Words are compared without case and ASCII punctuation, so neither hides a passage.

Defined results: null and empty texts match nothing, on both sides. An item of fewer than ``SEED`` words is
looked for as a whole. Items or documents that repeat are reported each. Ties go to the earlier place in
the item, then in the document. Clashing column names get an underscore.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deflow.llm import common
from deflow.llm.words import Words, portions, split

SEED = 5
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000     # 100 MB or so for a task
HIT = "item long, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>"


@dataclass
class Block:
    """Seeds of a block of items: sorted hashes, and for each the item and the word it begins at."""

    ids: list[int | None]
    lengths: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]     # width -> hash, item, place

    @staticmethod
    def of(items: list[tuple[int | None, bytes | None]], seed: int = SEED) -> Block:
        w = split([t for _, t in items], True)
        n = np.diff(w.first)
        seeds = {}
        for width in sorted(set(np.minimum(n[n > 0], seed).tolist())):
            own = np.flatnonzero(np.minimum(n, seed) == width)
            count = n[own] - width + 1
            item = np.repeat(own, count)
            at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            h = w.runs(w.first[item] + at, w.first[item] + at + width)
            order = np.lexsort((at, item, h))
            seeds[width] = (h[order], item[order], at[order])
        return Block([i for i, _ in items], n, seeds)


def blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, part by part; the driver holds one block at a time."""
    held: list[tuple[int | None, bytes | None]] = []
    total = 0
    for r in benchmark.select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        data = (r[1] or "").encode("utf-8", "surrogatepass")
        n = len(data) // 2 + 1      # words at most
        if held and total + n > limit:
            yield Block.of(held)
            held, total = [], 0
        if data:
            held.append((r[0], data))
            total += n
    if held:
        yield Block.of(held)


def tile(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words) from the places of shared seeds of ``width`` words."""
    order = np.lexsort((item, doc - item))
    item, doc = item[order], doc[order]
    new = np.ones(len(item), bool)
    new[1:] = ((doc - item)[1:] != (doc - item)[:-1]) | (item[1:] != item[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(item))) + width - 1
    heap = [(-n, i, j) for n, i, j in zip(length.tolist(), item[begin].tolist(), doc[begin].tolist())]
    heapq.heapify(heap)
    base = int(doc.min())
    item_used = np.zeros(int(item.max()) + width, bool)
    doc_used = np.zeros(int(doc.max()) - base + width, bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        used = item_used[i:i + n] | doc_used[j - base:j - base + n]
        if not used.any():
            item_used[i:i + n] = doc_used[j - base:j - base + n] = True
            out.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= width:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def contained(w: Words, block: Block, coverage: float = COVERAGE) -> list[list[tuple[int | None, float, list[tuple[int, int, int]]]]]:
    """For each text, the items that it contains: id, coverage, tiles."""
    out: list[list] = [[] for _ in range(len(w.first) - 1)]
    for width, (hashes, item, place) in block.seeds.items():
        n = len(w.hashes) - width + 1
        if n <= 0:
            continue
        at = np.arange(n)
        text = np.searchsorted(w.first, at, side="right") - 1
        h = w.runs(at, at + width)
        a = np.searchsorted(hashes, h)
        found = np.flatnonzero((hashes[np.minimum(a, len(hashes) - 1)] == h) & (at + width <= w.first[text + 1]))
        if not len(found):
            continue
        lo, hi = a[found], np.searchsorted(hashes, h[found], side="right")
        many = hi - lo
        source = np.repeat(found, many)
        seed = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        order = np.lexsort((item[seed], text[source]))
        source, seed = source[order], seed[order]
        pair = np.flatnonzero(np.concatenate([[True], (text[source][1:] != text[source][:-1]) | (item[seed][1:] != item[seed][:-1])]))
        for x, y in zip(pair.tolist(), np.append(pair[1:], len(source)).tolist()):
            d, k = int(text[source[x]]), int(item[seed[x]])
            if (y - x) * width < coverage * block.lengths[k]:
                continue    # that many seeds cannot cover enough words
            tiles = tile(place[seed[x:y]], source[x:y] - int(w.first[d]), width)
            share = sum(t[2] for t in tiles) / int(block.lengths[k])
            if share >= coverage:
                out[d].append((block.ids[k], share, sorted(tiles)))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, coverage, tiles."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *T._parse_datatype_string(HIT.replace("item long", "item_id long")).fields])
    shape = common.arrow_schema(schema)
    source = docs.select(docs[key].cast("long"), docs[text])
    out = None
    for block in blocks(benchmark, item_key, item_text):
        held = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, keys = common.utf8(b.column(1)), b.column(0).to_pylist()
                for x, y in portions(texts):
                    found = [(keys[x + d], i, c, [dict(zip(("item_at", "doc_at", "words"), t)) for t in tiles])
                             for d, rows in enumerate(contained(split(texts[x:y], True), held.value, coverage)) for i, c, tiles in rows]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), shape)], schema=shape)

        part = common.on_workers(source).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          coverage: float = COVERAGE) -> DataFrame:
    """The documents that contain no item, with their columns; no join, one pass per block."""
    common.on_workers(docs)
    for block in blocks(benchmark, item_key, item_text):
        docs = docs.where(_free_of(docs.sparkSession.sparkContext.broadcast(block), coverage)(docs[text]))
    return docs


def _free_of(held: Broadcast, coverage: float):
    """A filter on texts; only they go to Python."""
    @F.arrow_udf("boolean")
    def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = common.utf8(b)
            yield pa.array([not f for x, y in portions(texts) for f in contained(split(texts[x:y], True), held.value, coverage)], pa.bool_())
        common.release()

    return free
