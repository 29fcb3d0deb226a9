"""Schema relations that follow from the tape: control-flow edges, type facts, value-flow nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_ENDS = "array<struct<s:int,e:int,kind:string>>"
_EDGES = "array<struct<as:int,ae:int,bs:int,be:int,kind:string>>"


def _edges_sql() -> str:
    """Fold over the tape. ``ends`` are the nodes whose next one is not known yet, each with the kind of the
    edge that leaves it; ``open`` holds the regions around, with the exits of an arm that is already over."""
    to = lambda s, e, kind="x.kind": f"transform(a.ends, x -> struct(x.s AS as, x.e AS ae, {s} AS bs, {e} AS be, {kind} AS kind))"
    none = f"cast(array() AS {_ENDS})"
    one = lambda s, e, kind: f"array(struct({s} AS s, {e} AS e, '{kind}' AS kind))"
    state = lambda ends, open_, out: f"named_struct('ends', {ends}, 'open', {open_}, 'out', {out})"
    top, under = "a.open[size(a.open) - 1]", "slice(a.open, 1, size(a.open) - 1)"
    region = "array(struct(t.s AS s, t.e AS e, {exits} AS exits))"
    step = f"""CASE
        WHEN t.op IN ('if', 'loop') THEN {state(one('t.s', 't.e', 'TrueBranch'), f"concat(a.open, {region.format(exits=none)})", f"concat(a.out, {to('t.s', 't.e')})")}
        WHEN t.op = 'else' THEN {state(one(f'{top}.s', f'{top}.e', 'FalseBranch'), f"concat({under}, array(struct({top}.s AS s, {top}.e AS e, a.ends AS exits)))", 'a.out')}
        WHEN t.op = 'endif' THEN {state(f'concat({top}.exits, a.ends)', under, 'a.out')}
        WHEN t.op = 'endloop' THEN {state(one(f'{top}.s', f'{top}.e', 'FalseBranch'), under, f"concat(a.out, {to(f'{top}.s', f'{top}.e', chr(39) + 'LoopBack' + chr(39))})")}
        WHEN t.op = 'barrier' THEN {state(one('t.s', 't.e', 'Seq'), 'a.open', f"concat(a.out, {to('t.s', 't.e', chr(39) + 'Exception' + chr(39))})")}
        ELSE {state(one('t.s', 't.e', 'Seq'), 'a.open', f"concat(a.out, {to('t.s', 't.e')})")} END"""
    start = state(none, f"cast(array() AS array<struct<s:int,e:int,exits:{_ENDS}>>)", f"cast(array() AS {_EDGES})")
    return f"aggregate(tape, {start}, (a, t) -> {step}, a -> a.out)"


def cfg_edges(functions: DataFrame) -> DataFrame:
    """Control-flow edges between the facts of a function, found inside its row.

    A condition leads to the first fact of either arm, or behind the statement where an arm has none; both
    arms lead on behind it. A loop's last facts lead back to its condition, and that leads behind the loop.
    A barrier is entered exceptionally; the rest is sequence.
    """
    e = functions.select("ws", "uri", "fn", F.explode(F.expr(_edges_sql())).alias("x"))
    return e.select("ws", "uri", "fn", F.col("x.as").alias("a_start"), F.col("x.ae").alias("a_end"),
                    F.col("x.bs").alias("b_start"), F.col("x.be").alias("b_end"), "x.kind")


def type_facts(functions: DataFrame) -> DataFrame:
    """Nullability stated by annotations and None defaults."""
    t = functions.select("ws", "uri", "fn", "syms", F.explode("tape").alias("t")).where("t.ann <> 0Y")
    return t.select("ws", "uri", "fn", F.col("t.op").alias("op"), F.col("t.s").alias("start_byte"), F.col("t.e").alias("end_byte"),
                    F.expr("syms[t.slot]").alias("symbol"), F.expr("if(t.ann = 3Y, 'Nullable', 'NonNull')").alias("nullability"))


def value_flow_nodes(functions: DataFrame) -> DataFrame:
    """Sources of None, consumers, and assignments that pass values on."""
    role = F.expr("""CASE WHEN t.op = 'use' THEN 'consumer'
        WHEN t.op = 'param' AND t.ann = 3Y THEN 'source'
        WHEN t.op = 'assign' AND t.ann = 0Y AND t.r.k = 'literal' AND t.r.v = 3Y THEN 'source'
        WHEN t.op = 'assign' AND t.ann = 3Y THEN 'source'
        WHEN t.op = 'assign' AND t.r.k IN ('var', 'call') THEN 'transfer' END""")
    t = functions.select("ws", "uri", "fn", "syms", F.explode("tape").alias("t")).withColumn("role", role).where("role IS NOT NULL")
    return t.select("ws", "uri", "fn", "role", F.col("t.s").alias("start_byte"), F.col("t.e").alias("end_byte"),
                    F.expr("get(syms, t.slot)").alias("symbol"))
