"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. One scan sums words into at most ``2 ** CELL_BITS`` hash cells of each source (combined map-side, so a hot
   source costs no task more than others). Cells form blocks; a source's blocks stand in a permuted order.
2. Sources are a table throughout, numbered in order, and their number is not limited. The level up to which
   targets are filled follows from a few rounds of sums over them. A target is so many whole passes over a
   source's blocks and a part of one more, which ends inside a boundary block, cut once more by further bits of
   the hash to about ``BLOCK_DOCUMENTS`` documents, at a hash below which its documents are taken. A few single
   documents of that part close the remaining gap.
3. The tree splits the exact numbers of drawn blocks among output shards: each node deals its blocks of
   every source to its two halves by one multivariate-hypergeometric draw, made as a tree of draws between
   halves of the sources. So a source needs only the sums of the halves beside it, and a draw's shard is found by
   walking down from the root; no table of shards and no list of all sources exists anywhere. Draws of a source
   are disjoint ranges of its permuted blocks; inside a shard, rows are ordered by a hash. Where a node holds
   10^9 blocks or more, the draw between two halves is its expected value, rounded at random.

Defined results: a null source is a source of its own, after all others; a null text has no words, and a
source without words has target 0. Rows that repeat are drawn together. An empty table gives an empty mix.
Clashing column names get an underscore. All draws depend on the rows and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deflow.llm import common

WEIGHTS = (5.0, 2.0, 1.0)   # dealt to sources in order, repeating
SHARE = 1.5                 # of all words, for the whole mix
MOST = 2.0                  # times its source's words, for a target
CELL_BITS = 14
BLOCK_DOCUMENTS = 1024      # wanted in a block, while a source has fewer than 2 ** CELL_BITS of them
SHARD_WORDS = 8_000_000
FILLS = 16                  # single documents that close the gap of one source at most
REMEMBERED = 500_000        # draws that a task keeps; others are made again, with the same result


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: shared by weight, none above ``most`` times its size, the excess shared again."""
    total = share * sum(sizes)
    out: dict[int, float] = {i: 0.0 for i, s in enumerate(sizes) if not s}
    while len(out) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in out]
        unit = max(0.0, total - sum(out.values())) / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        out |= {i: most * sizes[i] for i in full} if full else {i: unit * weights[i] for i in open_}
    return [out[i] for i in range(len(sizes))]


def _first(seed: list[int], even: int, odd: int, want: int) -> int:
    """How many of ``want`` blocks come from the first of two groups."""
    if not even or not odd or not want or want == even + odd:
        return min(even, want) if not odd or want == even + odd else 0
    rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed)))
    if even + odd < 10 ** 9:
        return int(rng.hypergeometric(even, odd, want))
    whole, rest = divmod(want * even, even + odd)
    return min(even, want, max(want - odd, whole + int(rng.random() < rest / (even + odd))))


def walk(source: int, own: int, beside: list[int], draws: np.ndarray, shards: int, seed: int, memory: dict) -> np.ndarray:
    """The shards of draws of one source.

    ``own`` is its number of blocks, ``beside[j]`` that of the ``2 ** j`` sources next to the ``2 ** j`` aligned
    ones that it is among. ``memory`` keeps what other walks can use again.
    """
    out = np.zeros(len(draws), np.int32)
    todo = [(0, shards, own, list(beside), np.arange(len(draws)), draws.astype(np.int64))]
    while todo:
        lo, hi, own, beside, rows, place = todo.pop()
        if not len(rows) or hi - lo == 1:
            out[rows] = lo
            continue
        mid = (lo + hi) // 2
        left, total = [0] * len(beside), own + sum(beside)
        mine, inside = total * (mid - lo) // (hi - lo), total    # of the group that the source is among
        for j in range(len(beside) - 1, -1, -1):
            here = source >> j
            inside -= beside[j]
            at = (lo, hi, j, here >> 1)
            if at not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                pair = (inside, beside[j]) if not here & 1 else (beside[j], inside)
                memory[at] = _first([seed, *at], *pair, mine)
            even = memory[at]
            mine, left[j] = (even, mine - even) if not here & 1 else (mine - even, even)
        first = place < mine
        todo.append((lo, mid, mine, left, rows[first], place[first]))
        todo.append((mid, hi, own - mine, [b - x for b, x in zip(beside, left)], rows[~first], (place - mine)[~first]))
    return out


@dataclass(frozen=True)
class SplittingTree:
    """Deals ``counts[s]`` blocks of each source to ``shards`` shards, where all counts are at hand."""

    counts: tuple[int, ...]
    shards: int
    seed: int

    def shard_of(self, source: np.ndarray, draw: np.ndarray, memory: dict) -> np.ndarray:
        """The shards of draws; ``memory`` keeps the nodes met before."""
        out = np.zeros(len(draw), np.int32)
        for s in np.unique(source).tolist():
            beside = [sum(self.counts[((s >> j) ^ 1) << j:(((s >> j) ^ 1) + 1) << j]) for j in range((len(self.counts) - 1).bit_length())]
            rows = np.flatnonzero(source == s)
            out[rows] = walk(s, self.counts[s], beside, draw[rows], self.shards, self.seed, memory)
        return out


def close_gap(marks: np.ndarray, sizes: np.ndarray, gap: float) -> tuple[int | None, list[int]]:
    """Of a block's documents, in the order of their marks: the last mark up to which all are taken, and
    single marks behind it, so that the words taken come as near to ``gap`` as these moves can bring them."""
    order = np.argsort(marks, kind="stable")
    marks, sizes = marks[order], sizes[order].astype(np.float64)
    n = int(np.searchsorted(np.cumsum(sizes), gap, side="right"))
    left, marks_left, sizes_left = gap - sizes[:n].sum(), marks[n:], sizes[n:].copy()
    fills: list[int] = []
    while len(fills) < FILLS and (fit := np.flatnonzero((sizes_left <= left) & (sizes_left > 0))).size:
        i = fit[np.argmax(sizes_left[fit])]
        fills.append(int(marks_left[i]))
        left -= sizes_left[i]
        sizes_left[i] = 0
    if (over := np.flatnonzero(sizes_left > 0)).size:
        i = over[np.argmin(sizes_left[over])]
        if abs(left - sizes_left[i]) < left:
            fills.append(int(marks_left[i]))
    return (int(marks[n - 1]) if n else None), fills


def numbered(sums: DataFrame) -> DataFrame:
    """Sources with their place ``s`` in order, null last: sorted in ranges, whose sizes are all that is collected."""
    order = F.col("s_name").asc_nulls_last()
    ranges = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = common.written(sums.repartitionByRange(ranges, order).sortWithinPartitions(order).select(
        "*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "mix-sources")
    starts, at = [], 0
    for r in sorted(rows.groupBy("p").count().collect()):
        starts.append((r["p"], at))
        at += r["count"]
    return rows.join(sums.sparkSession.createDataFrame(starts, "p int, start long"), "p").withColumn("s", F.col("start") + F.col("i")).drop("p", "i", "start")


def level(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[float, int]:
    """Words for each unit of weight, beyond which only full sources stay behind, and all words.

    Each round is one sum over the sources by their weight; sums are of whole numbers, so no order matters.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])[F.col("j")]
    unit, before, words = 0.0, -1, 0
    while True:
        full = F.lit(unit) * w > F.lit(most) * F.col("words")
        got = sorted(sources.where("words > 0").groupBy("j").agg(
            F.sum("words").alias("words"), F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).alias("full_words"),
            F.count_if(full).alias("full"), F.count_if(~full).alias("open")).collect(), key=lambda r: r["j"])
        words = sum(r["words"] for r in got)
        open_, filled = sum(weights[r["j"]] * r["open"] for r in got), sum(r["full"] for r in got)
        if filled == before or not open_:
            return unit, words
        before, unit = filled, max(unit, (share * words - most * sum(r["full_words"] for r in got)) / open_)


def with_beside(plan: DataFrame, n: int) -> DataFrame:
    """``plan`` with ``beside``: for each j the ``count`` of the aligned ``2 ** j`` sources next to the source's own."""
    depth = (n - 1).bit_length() if n else 0
    if not depth:
        return plan.withColumn("beside", F.array().cast("array<long>"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    groups = plan.select(F.col("s"), F.col("count"), steps.alias("j")).groupBy("j", F.expr("shiftright(s, j)").alias("g")).agg(F.sum("count").alias("sum"))
    wanted = plan.select("s", steps.alias("j")).withColumn("g", F.expr("shiftright(s, j) ^ 1L"))
    found = wanted.join(groups, ["j", "g"], "left").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("j", F.coalesce("sum", F.lit(0).cast("long")).alias("sum")))).alias("x"))
    return plan.join(found.select("s", F.expr("transform(x, y -> y.sum)").alias("beside")), "s")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17,
        shards: int | None = None) -> DataFrame:
    """One row per document: ``keep`` columns (all by default), size, source_size, target, taken, draws, shards, ranks.

    ``draws`` are the positions of its copies in its source's sequence, ``shards`` where each copy goes and
    ``ranks`` its place there; a document that is left out has none.
    """
    docs = common.on_workers(docs)
    keep = list(docs.columns) if keep is None else keep
    p = {n: f"_{n}" for n in ("source", "size", "mark")}
    rows = docs.select(     # kept columns have numbers for names until the end, so they meet no other
        *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[source].cast("string").alias(p["source"]),
        F.coalesce(F.regexp_count(docs[text], F.lit(common.WORD)), F.lit(0)).cast("long").alias(p["size"]),
        F.xxhash64(docs[key], docs[text], F.lit(seed)).alias(p["mark"]))
    cell = F.shiftrightunsigned(F.col(p["mark"]), 64 - CELL_BITS)
    cells = common.written(rows.groupBy(F.col(p["source"]).alias("s_name"), cell.alias("cell")).agg(
        F.sum(p["size"]).alias("words"), F.count(F.lit(1)).alias("rows")), "mix-cells")
    sources = numbered(cells.groupBy("s_name").agg(F.sum("words").alias("words"), F.sum("rows").alias("rows"))).withColumn(
        "j", (F.col("s") % len(weights)).cast("int"))
    unit, words = level(sources, weights, share, most)
    most_, weighed = F.lit(most) * F.col("words"), F.lit(unit) * F.array(*[F.lit(float(x)) for x in weights])[F.col("j")]
    bits = lambda c: F.expr(f"least({CELL_BITS}, length(bin({c} div {BLOCK_DOCUMENTS})) - 1)")
    h, mask = F.xxhash64("s_name", F.lit(seed)), F.expr("shiftleft(1L, bits) - 1")
    sources = sources.withColumn("bits", bits("rows")).withColumn("sub", bits("shiftright(rows, bits)")).select(
        "s_name", "s", "words", "bits", "sub", h.bitwiseAND(mask).bitwiseOR(F.lit(1)).alias("mult"), F.shiftrightunsigned(h, 32).bitwiseAND(mask).alias("add"),
        F.when(F.col("words") == 0, 0.0).when(weighed > most_, most_).otherwise(weighed).alias("target")).withColumn(
        "base", F.expr("CASE WHEN words = 0 THEN 0 ELSE cast(floor(target / words) AS int) END")).withColumn("rest", F.expr("target - base * words"))
    sources = common.written(sources, "mix-plan")

    def placed(df: DataFrame, name: str, c: Column, small: DataFrame) -> DataFrame:
        """Rows with their source's plan and the place of their cell's block in the permuted order."""
        small = small.withColumnRenamed("s_name", "_plan_name")
        block = F.expr(f"cast(shiftright(_cell, {CELL_BITS} - bits) AS long)")
        return df.withColumn("_cell", c).join(small, df[name].eqNullSafe(small["_plan_name"])).withColumn("_block", block).withColumn(
            "_pos", F.expr("(mult * _block + add) & (shiftleft(1L, bits) - 1)"))

    def boundary(df: DataFrame, place: str, gap: str) -> DataFrame:
        """The last place of each source that begins below its gap, and the gap that is left there; places are at most 2 ** CELL_BITS."""
        before = F.expr(f"sum(words) OVER (PARTITION BY s ORDER BY {place}) - words")
        return df.withColumn("before", before).where(f"before < {gap} AND words > 0").groupBy("s").agg(
            F.max(place).alias(place), F.max_by(F.col(gap) - F.col("before"), place).alias(f"{place}_gap"))

    plan = sources.select("s_name", "s", "bits", "sub", "mult", "add", "rest")
    edges = boundary(placed(cells, "s_name", F.col("cell"), plan).groupBy("s", "rest", "_pos").agg(F.sum("words").alias("words")), "_pos", "rest")
    edges = common.written(edges.withColumnsRenamed({"_pos": "last", "_pos_gap": "gap"}), "mix-edges")
    part = F.expr(f"CASE WHEN sub = 0 THEN 0L ELSE shiftrightunsigned(shiftleft({p['mark']}, bits), 64 - sub) END")
    block = common.written(placed(rows.select(p["source"], p["size"], p["mark"]), p["source"], cell, plan.join(edges, "s")).where("_pos = last").groupBy(
        "s", "gap", part.alias("_part"), F.col(p["mark"]).alias("m")).agg(F.sum(p["size"]).alias("n")), "mix-block")
    parts = boundary(block.groupBy("s", "gap", "_part").agg(F.sum("n").alias("words")), "_part", "gap")

    def choose(d: pd.DataFrame) -> pd.DataFrame:
        mark, fills = close_gap(d["m"].to_numpy(), d["n"].to_numpy(), float(d["_part_gap"].iloc[0]))
        low = int(d["m"].min())     # all of the parts before this one is taken
        mark = mark if mark is not None else low - 1 if low > -2 ** 63 else None
        return pd.DataFrame({"s": [d["s"].iloc[0]], "mark": pd.array([mark], "Int64"), "fills": [fills]})

    chosen = block.join(parts, ["s", "_part"]).select("s", "m", "n", "_part_gap").groupBy("s").applyInPandas(choose, "s long, mark long, fills array<long>")
    plan = sources.join(edges.drop("gap"), "s", "left").join(chosen, "s", "left").withColumn("last", F.coalesce("last", F.lit(-1).cast("long"))).withColumn(
        "fills", F.coalesce("fills", F.array().cast("array<long>"))).withColumn("count", F.expr("base * shiftleft(1L, bits) + last + 1"))
    plan = common.written(plan.drop("rest", "sub"), "mix-plan-whole")
    plan = common.written(with_beside(plan, plan.count()), "mix-tree")
    shards = shards or max(1, -(-int(min(share, most) * words) // SHARD_WORDS))

    @F.pandas_udf("array<int>")
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memory: dict = {}
        for s, own, beside, d in batches:
            n = np.array([len(x) for x in d], np.int64)
            flat = np.concatenate([*d, np.zeros(0, np.int64)]).astype(np.int64)
            at, found = common.offsets_of(n), np.zeros(len(flat), np.int32)
            source, row = np.repeat(s.to_numpy(), n), np.repeat(np.arange(len(n)), n)
            by_source = np.argsort(source, kind="stable")
            for places in np.split(by_source, np.flatnonzero(np.diff(source[by_source])) + 1):
                if len(places):
                    i = row[places[0]]
                    found[places] = walk(int(s.iloc[i]), int(own.iloc[i]), [int(x) for x in beside.iloc[i]], flat[places], shards, seed, memory)
            yield pd.Series([found[a:b] for a, b in zip(at, at[1:])])

    names = {n: common.fresh(keep, n) for n in ("size", "source_size", "target", "taken", "draws", "shards", "ranks")}
    full = placed(rows, p["source"], cell, plan)
    extra = F.expr(f"_pos < last OR (_pos = last AND (coalesce({p['mark']} <= mark, false) OR array_contains(fills, {p['mark']})))")
    passes = F.col("base") + extra.cast("int")
    draws = F.expr("transform(sequence(1, _n), x -> cast(x - 1 AS long) * shiftleft(1L, bits) + _pos)")
    full = full.withColumn("_n", passes).withColumn("_draws", F.when(F.col("_n") > 0, draws).otherwise(F.array().cast("array<long>")))
    return full.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col(p["size"]).alias(names["size"]), F.col("words").alias(names["source_size"]),
        F.col("target").alias(names["target"]), (F.col(p["size"]) * F.col("_n")).alias(names["taken"]), F.col("_draws").alias(names["draws"]),
        shard_of(F.col("s"), F.col("count"), F.col("beside"), F.col("_draws")).alias(names["shards"]),
        F.transform("_draws", lambda x: F.xxhash64(F.col(p["mark"]), x)).alias(names["ranks"]))


def assemble(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: one row per copy, shards in partitions, shuffled inside by rank."""
    draws, shards, ranks = mixed.columns[-3:]
    copy = common.fresh(columns, "_copy")
    rows = mixed.select(*[mixed[c] for c in columns], F.explode(F.arrays_zip(F.col(shards).alias("shard"), F.col(ranks).alias("rank"))).alias(copy))
    return rows.repartition(f"{copy}.shard").sortWithinPartitions(f"{copy}.shard", f"{copy}.rank").select(*columns)
