"""Interprocedural nullability: summaries to a fixpoint, contexts to a closure, then regressions.

Function tapes are hash-placed by their key once and never move again; only small summary rows are
shuffled in the rounds. A round re-folds just the callers of functions whose summary changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deflow.functions.lattice import NULLNESS, Domain
from deflow.operators.facts import tapes
from deflow.operators.fold import SUMMARY, contexts_sql, fold_sql, summary_sql
from deflow.operators.skew import hot_keys, lookup
from deflow.session import cut

KEY = ["ws", "uri", "fn"]
CALLEE = ["ws", "c_uri", "c_fn"]


@dataclass
class Solved:
    """Results of one analysis; every field is a DataFrame with its lineage already cut."""

    functions: DataFrame   # KEY, names, tape, summ (slot -> callee summary), ctxs
    links: DataFrame       # resolved calls: KEY, slot -> c_uri, c_fn, c_params, t_fn
    informative: DataFrame  # KEY, base, nfp of functions that say more than "unknown"
    summaries: DataFrame   # KEY, func_name, base, nfp of all functions
    regressions: DataFrame
    reached: DataFrame     # KEY, ctx: contexts reached with a nullable argument (see ``reach``)
    hot: list[tuple]
    rounds: int
    domain: Domain = NULLNESS


def alone(functions: DataFrame, domain: Domain = NULLNESS) -> DataFrame:
    """Functions with the result of every context when no callee is known."""
    return functions.withColumn("summ", _no_summaries()).withColumn("ctxs", F.expr(contexts_sql(domain))).drop("summ")


def place(functions: DataFrame, domain: Domain = NULLNESS) -> DataFrame:
    """Spread functions over the shuffle partitions by key and keep them there.

    Every function is folded once on the way, knowing no callee (``ctxs``). For functions without
    resolvable calls that is already the final result.
    """
    n = int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = functions if "ctxs" in functions.columns else alone(functions, domain)
    return cut(ready.repartition(n, *KEY), keep_layout=True)


def definitions(functions: DataFrame, scope: str) -> DataFrame:
    """What each name resolves to.

    Workspace scope: a name resolves only when defined exactly once in the workspace. File scope: only
    within the file, the last definition of a name giving its summary and the first its witness.
    """
    unit = ["ws"] if scope == "workspace" else ["ws", "uri"]
    names = functions.select(*KEY, "func_name", "n_params")
    me = F.struct("uri", "fn", "n_params")
    first, last = F.min(me), F.max(me)
    defs = names.groupBy(*unit, "func_name").agg(F.count(F.lit(1)).alias("n"), first.alias("lo"), last.alias("hi"))
    if scope == "workspace":
        defs = defs.where("n = 1")
    return defs.select(*unit, F.col("func_name").alias("callee"), F.col("hi.uri").alias("c_uri"),
                       F.col("hi.fn").alias("c_fn"), F.col("hi.n_params").alias("c_params"), F.col("lo.fn").alias("t_fn"))


def resolve(functions: DataFrame, scope: str) -> tuple[DataFrame, list[tuple]]:
    """Match call names with definitions (see ``definitions``)."""
    unit = ["ws"] if scope == "workspace" else ["ws", "uri"]
    # Names are read four times or more, so that much is kept apart: a kept row with its tape is only read as a whole.
    names = cut(functions.select(*KEY, "func_name", "n_params", "callees"))
    defs = definitions(names, scope)
    calls = names.select(*KEY, F.posexplode("callees").alias("slot", "callee"))
    # Builtins such as len() are called everywhere and defined nowhere: the hot-key path keeps them
    # from meeting in one task only to be dropped.
    links = cut(lookup(calls, defs, unit + ["callee"], hot=hot_keys(calls, unit + ["callee"])))
    return links, hot_keys(links, CALLEE)


def _callee_summaries(links: DataFrame, summaries: DataFrame, hot: list[tuple]) -> DataFrame:
    """Per caller the map slot -> callee summary; a callee without informative summary is plain unknown."""
    s = summaries.select("ws", F.col("uri").alias("c_uri"), F.col("fn").alias("c_fn"), "base", "nfp")
    known = lookup(links, s, CALLEE, "left", hot)
    entry = F.struct("slot", F.struct(
        F.coalesce("base", F.lit(1).cast("tinyint")).alias("base"),
        F.coalesce("nfp", F.array().cast("array<boolean>")).alias("nfp"), "c_uri", "c_fn", "c_params", "t_fn").cast(SUMMARY))
    return known.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(entry)).alias("summ"))


def _no_summaries():
    return F.expr(f"map_from_entries(cast(array() AS array<struct<slot:int,s:{SUMMARY}>>))")


INFORMATIVE = "(base <> 1Y OR exists(nfp, x -> x))"


def summarise(functions: DataFrame, links: DataFrame, hot: list[tuple], todo: DataFrame | None = None,
              keep: DataFrame | None = None, domain: Domain = NULLNESS) -> tuple[DataFrame, int]:
    """Summaries of all functions at the fixpoint; functions without information are left out.

    Rounds are bounded by the number of functions, as a reversed linear chain needs one each.
    Incrementally, only ``todo`` (see ``affected``) is computed, from nothing, and ``keep`` holds the
    summaries of all others, which cannot change.
    """
    leaf = functions.select(*KEY, F.expr("ctxs[0].ret AS base"), F.expr(
        f"transform(slice(ctxs, 2, n_params), x -> x.ret = {domain.reported}Y) AS nfp"))
    sm = F.expr(summary_sql(domain))
    fold = lambda df: df.select(*KEY, sm.alias("sm")).select(*KEY, "sm.base", "sm.nfp")
    informative = F.expr(INFORMATIVE)
    if keep is None:
        current = cut(leaf.where(informative).withColumn("moved", F.lit(True)))
    else:
        maps = _callee_summaries(links.join(todo, KEY, "left_semi"), keep, hot)
        calling = fold(functions.join(maps, KEY))
        first = leaf.join(todo, KEY, "left_semi").join(maps, KEY, "left_anti").unionByName(calling)
        current = cut(first.where(informative).withColumn("moved", F.lit(True)).unionByName(keep.withColumn("moved", F.lit(False))))
    # Only functions with a resolved call are ever folded again, and a fold needs no more than these columns.
    callers = cut(functions.join(links.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "n_params", "syms", "tape"), keep_layout=True)
    bound, rounds = None, 1
    while True:
        moved = current.where("moved").select("ws", F.col("uri").alias("c_uri"), F.col("fn").alias("c_fn"))
        front = lookup(links, moved, CALLEE, "inner", hot).select(*KEY).distinct()
        maps = _callee_summaries(links.join(front, KEY, "left_semi"), current.drop("moved"), hot)
        again = fold(callers.join(maps, KEY)).select(*KEY, F.struct("base", "nfp").alias("new"))
        old = current.select(*KEY, F.struct("base", "nfp").alias("old"))
        differs = F.when(F.col("old").isNull(), F.expr("(new.base <> 1Y OR exists(new.nfp, x -> x))")).otherwise(
            (F.col("old.base") != F.col("new.base")) | (F.col("old.nfp") != F.col("new.nfp")))
        merged = old.join(again, KEY, "full_outer").select(
            *KEY, F.coalesce("new.base", "old.base").alias("base"), F.coalesce("new.nfp", "old.nfp").alias("nfp"),
            (F.col("new").isNotNull() & differs).alias("moved"))
        # A function that lost its information stays one round as a moved row, so that callers hear of it.
        current = cut(merged.where(informative | F.col("moved")))
        rounds += 1
        if current.where("moved").isEmpty():
            break
        bound = bound or callers.count() + 1
        if rounds > bound:
            break
    return current.drop("moved").where(informative), rounds


def affected(links: DataFrame, changed: DataFrame, hot: list[tuple]) -> DataFrame:
    """``changed`` functions and everything that calls them, directly or not."""
    seen = frontier = cut(changed.select(*KEY).distinct())
    while not frontier.isEmpty():
        target = frontier.select("ws", F.col("uri").alias("c_uri"), F.col("fn").alias("c_fn"))
        frontier = cut(lookup(links, target, CALLEE, "inner", hot).select(*KEY).distinct().join(seen, KEY, "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def changed_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions whose call resolution differs, for example because a name became ambiguous."""
    cols = KEY + ["slot", "c_uri", "c_fn", "c_params", "t_fn"]
    b, a = before.select(*cols), after.select(*cols)
    return a.join(b, cols, "left_anti").select(*KEY).unionByName(b.join(a, cols, "left_anti").select(*KEY)).distinct()


def resume(functions: DataFrame, before: Solved, changed: DataFrame, scope: str = "workspace") -> Solved:
    """Re-analyse after an edit. ``functions`` is the new state, ``changed`` the keys that are new,
    edited or gone. Only affected functions are folded again; everyone else keeps summary and contexts,
    so a change that leaves all summaries of a file as they were stops right there."""
    links, hot = resolve(functions, scope)
    start = changed.select(*KEY).unionByName(changed_links(before.links, links)).distinct()
    both = links.select(*KEY, *CALLEE[1:]).unionByName(before.links.select(*KEY, *CALLEE[1:])).distinct()
    todo = affected(cut(both), start, hot)
    keep = before.informative.join(todo, KEY, "left_anti")
    current, rounds = summarise(functions, links, hot, todo, keep, before.domain)
    redo = fold_contexts(functions.join(todo, KEY, "left_semi"), links.join(todo, KEY, "left_semi"), current, hot, before.domain)
    folded = cut(before.functions.join(todo, KEY, "left_anti").unionByName(redo), keep_layout=True)
    return finish(folded, links, current, hot, rounds, before.domain)


def reach(folded: DataFrame) -> DataFrame:
    """(function, parameter) contexts reachable with a nullable argument from any entry point.

    ``folded`` has KEY and ``ctxs``. Semi-naive closure: each round follows the edges of newly
    reached contexts only, and targets are made distinct before they are compared.
    """
    edges = cut(folded.select(*KEY, F.posexplode("ctxs").alias("p", "x")).select(
        *KEY, (F.col("p") - 1).alias("ctx"), F.explode("x.called").alias("to")).select(
        *KEY, "ctx", "to.c_uri", "to.c_fn", F.col("to.ctx").alias("c_ctx")))
    target = lambda df: df.select("ws", F.col("c_uri").alias("uri"), F.col("c_fn").alias("fn"), F.col("c_ctx").alias("ctx")).distinct()
    onward = edges.where("ctx >= 0")
    seen = frontier = cut(target(edges.where("ctx = -1")))
    while not frontier.isEmpty():
        frontier = cut(target(onward.join(frontier, KEY + ["ctx"], "left_semi")).join(seen, KEY + ["ctx"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def regressions_of(folded: DataFrame, reached: DataFrame) -> DataFrame:
    """Distinct dereferences of a nullable value, attributed to the function that contains them."""
    per_fn = reached.groupBy(*KEY).agg(F.collect_set("ctx").alias("seen"))
    live = "array_distinct(flatten(transform(filter(ctxs, (x, p) -> p = 0 OR array_contains(seen, p - 1)), x -> x.hits)))"
    return _told(folded.join(per_fn, KEY, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>"))), F.expr(live))


def _told(functions: DataFrame, hits) -> DataFrame:
    """One row for each dereference of ``hits``."""
    return functions.select(*KEY, "func_name", "func_start", "func_end", "syms", F.explode(hits).alias("h")).select(
        *KEY, "func_name", "func_start", "func_end", F.col("h.s").alias("start_byte"),
        F.col("h.e").alias("end_byte"), F.expr("syms[h.slot]").alias("symbol"), F.col("h.kind").alias("kind"))


def intraprocedural(functions: DataFrame, domain: Domain = NULLNESS) -> DataFrame:
    """Regressions with no knowledge of callees at all: nothing reaches a parameter, so one context tells all.

    Placed functions have it folded; tapes straight from the text are folded in that context alone.
    """
    if "ctxs" in functions.columns:
        return _told(functions, F.array_distinct(F.expr("ctxs[0].hits")))
    once = functions.withColumn("summ", _no_summaries()).withColumn("hits", F.expr(f"{fold_sql('-1', True, domain)}.hits"))
    return _told(once, F.array_distinct("hits"))


def fold_contexts(functions: DataFrame, links: DataFrame, current: DataFrame, hot: list[tuple], domain: Domain = NULLNESS) -> DataFrame:
    """Functions with their callee summaries and the result of every context.

    Only functions with a resolved call are folded again.
    """
    maps = _callee_summaries(links, current, hot)
    called = functions.withColumnRenamed("ctxs", "alone").join(maps, KEY, "left")
    return called.withColumn("ctxs", F.when(F.col("summ").isNull(), F.col("alone")).otherwise(F.expr(contexts_sql(domain)))).withColumn(
        "summ", F.coalesce("summ", _no_summaries())).drop("alone")


def finish(folded: DataFrame, links: DataFrame, current: DataFrame, hot: list[tuple], rounds: int, domain: Domain = NULLNESS) -> Solved:
    reached = reach(folded.select(*KEY, "ctxs"))
    regressions = cut(regressions_of(folded, reached))
    flags = F.expr("transform(filter(sequence(0, n_params), c -> c < n_params), c -> false)")
    summaries = folded.select(*KEY, "func_name", "n_params").join(current, KEY, "left").select(
        *KEY, "func_name", F.coalesce("base", F.lit(1).cast("tinyint")).alias("base"), F.coalesce("nfp", flags).alias("nfp"))
    return Solved(folded, links, current, summaries, regressions, reached, hot, rounds, domain)


def solve(functions: DataFrame, scope: str = "workspace", domain: Domain = NULLNESS) -> Solved:
    """Analyse ``functions`` placed for ``domain`` (see ``place``) over whole workspaces or file by file."""
    links, hot = resolve(functions, scope)
    current, rounds = summarise(functions, links, hot, domain=domain)
    return finish(cut(fold_contexts(functions, links, current, hot, domain), keep_layout=True), links, current, hot, rounds, domain)


def solve_sources(parsed: DataFrame, scope: str = "workspace") -> Solved:
    """Parse results in, analysis out."""
    return solve(place(tapes(parsed)), scope)
