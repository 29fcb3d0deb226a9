"""Forward nullability analysis of one function as a fold over its tape.

``aggregate`` walks the tape with a stack of environments: a region marker pushes a narrowed copy,
its end pops and joins. An environment is an ``array<tinyint>`` indexed by symbol slot, where 0
(absent) differs from 1 (present but unknown). Every function is folded once per context: -1 is
"all parameters unknown", i is "parameter i nullable".

What values mean and how they join comes from a ``Domain``; the fold knows regions and calls only.
"""

from __future__ import annotations

from deflow.functions.lattice import NULLNESS, Domain

HIT = "struct<s:int,e:int,slot:int,kind:string>"
SUMMARY = "struct<base:tinyint,nfp:array<boolean>,c_uri:string,c_fn:int,c_params:int,t_fn:int>"
CALLED = "struct<c_uri:string,c_fn:int,ctx:int>"
SHORT = 32      # symbols of an environment that is rewritten element by element


def _let(var: str, value: str, body: str) -> str:
    return f"transform(array({value}), {var} -> {body})[0]"


def _set(env: str, slot: str, value: str) -> str:
    """``env`` with another value in ``slot``: element by element while it is short, from its pieces beyond that."""
    pieces = f"concat(slice({env}, 1, {slot}), array(nv), slice({env}, {slot} + 2, size({env})))"
    return _let("nv", value, f"if(size({env}) > {SHORT}, {pieces}, transform({env}, (x, k) -> if(k = {slot}, nv, x)))")


def _narrow(env: str, side: str, d: Domain) -> str:
    cleared = f"if(size(t.c.refs) > 0, transform({env}, (x, k) -> if(array_contains(t.c.refs, k), 1Y, x)), {env})"
    return _let("en", cleared, f"if(t.c.s IS NULL OR t.c.{side} = 0Y, en, {_set('en', 't.c.s', d.code_sql(f't.c.{side}'))})")


def _join(a: str, b: str, d: Domain) -> str:
    return f"zip_with({a}, {b}, (x, y) -> {d.join_sql('x', 'y')})"


_UNDER = "slice(acc.st, 1, size(acc.st) - 1)"
_PREV = "acc.st[size(acc.st) - 1]"
# Whether the call resolves at all.
_OPEN = "((t.r.recv IS NULL OR acc.env[t.r.recv] = 0Y) AND summ[t.r.callee] IS NOT NULL)"


def _nulls(d: Domain) -> str:
    """Argument positions that bring the reported value into this call."""
    return f"(filter(transform(t.r.args, (a, p) -> if(a = -1 OR (a >= 0 AND acc.env[a] = {d.reported}Y), p, -1)), p -> p >= 0))"


def _value(d: Domain) -> str:
    return f"""CASE t.r.k WHEN 'literal' THEN {d.code_sql('t.r.v')}
    WHEN 'var' THEN greatest(acc.env[t.r.s], 1Y)
    WHEN 'call' THEN if({_OPEN},
        if(exists({_nulls(d)}, p -> coalesce(get(summ[t.r.callee].nfp, p), false)), {d.reported}Y, summ[t.r.callee].base), 1Y)
    ELSE 1Y END"""


def _acc(st="acc.st", env="acc.env", ret="acc.ret", hits="acc.hits", called="acc.called") -> str:
    return f"named_struct('st', {st}, 'env', {env}, 'ret', {ret}, 'hits', {hits}, 'called', {called})"


def fold_sql(ctx: str, collect: bool, d: Domain = NULLNESS) -> str:
    """Fold of ``tape`` in context ``ctx`` with callee summaries ``summ`` (slot -> summary), over domain ``d``.

    Gives ``struct<ret, hits, called>``; ``collect=False`` skips everything but the return value. The environment
    in force stands beside the stack of those below it, so that what changes nothing hands ``acc`` on as it is.
    """
    start = f"transform(syms, (x, k) -> cast(if(k = {ctx}, {d.reported}, if(k < n_params, 1, 0)) AS tinyint))"
    ret = _let("v", _value(d), f"if(acc.ret = 0Y, v, {_let('w', 'acc.ret', d.join_sql('w', 'v'))})" if d.join_sql('w', 'v').count('array') else 'if(acc.ret = 0Y OR acc.ret = v, v, 1Y)')
    hits = "concat(acc.hits, array(struct(t.s AS s, t.e AS e, t.slot AS slot, t.kind AS kind)))"
    called = f"""concat(acc.called,
        transform(filter({_nulls(d)}, p -> p < summ[t.r.callee].c_params),
                  p -> struct(summ[t.r.callee].c_uri AS c_uri, summ[t.r.callee].c_fn AS c_fn, p AS ctx)))"""
    flows = f"t.r.k = 'call' AND {_OPEN}"
    tell = lambda also="": f"if({also}{flows}, {called}, acc.called)" if collect else "acc.called"
    use = f"if(acc.env[t.slot] = {d.reported}Y, {_acc(hits=hits)}, acc)" if collect else "acc"
    call = f"if({flows}, {_acc(called=called)}, acc)" if collect else "acc"
    ann = d.code_sql("t.ann")
    set_to = lambda value: _set("acc.env", "t.slot", value)
    pushed, joined = "concat(acc.st, array(acc.env))", _let("pe", _PREV, _join("pe", "acc.env", d))
    bound = "if(size(t.bound) > 0, transform(acc.env, (x, k) -> if(array_contains(t.bound, k), 1Y, x)), acc.env)"
    step = f"""CASE
        WHEN t.op = 'use' THEN {use}
        WHEN t.op = 'assign' THEN {_acc(env=set_to(f'if(t.ann <> 0Y, {ann}, {_value(d)})'), called=tell('t.ann = 0Y AND '))}
        WHEN t.op = 'param' THEN if(t.ann <> 0Y, {_acc(env=set_to(ann))}, acc)
        WHEN t.op = 'return' THEN {_acc(ret=ret, called=tell())}
        WHEN t.op = 'call' THEN {call}
        WHEN t.op = 'if' THEN {_acc(st=pushed, env=_narrow('acc.env', 't', d))}
        WHEN t.op = 'else' THEN {_acc(st=f'concat({_UNDER}, array(acc.env))', env=_let('pe', _PREV, _narrow('pe', 'f', d)))}
        WHEN t.op IN ('endif', 'endloop') THEN {_acc(st=_UNDER, env=joined)}
        WHEN t.op = 'loop' THEN {_acc(st=pushed, env=_let('be', bound, _narrow('be', 't', d)))}
        WHEN t.op = 'assume' THEN {_acc(env=_narrow('acc.env', 't', d))}
        WHEN t.op = 'barrier' THEN {_acc(env='array_repeat(0Y, size(acc.env))')}
        ELSE acc END"""
    zero = (f"named_struct('st', cast(array() AS array<array<tinyint>>), 'env', cast({start} AS array<tinyint>), 'ret', 0Y, "
            f"'hits', cast(array() AS array<{HIT}>), 'called', cast(array() AS array<{CALLED}>))")
    return (f"aggregate(tape, {zero}, (acc, t) -> {step}, "
            f"acc -> named_struct('ret', greatest(acc.ret, 1Y), 'hits', acc.hits, 'called', array_distinct(acc.called)))")


def summary_sql(d: Domain = NULLNESS) -> str:
    """``struct<base, nfp>`` of a function: its return value with unknown parameters, and per parameter
    whether making it the reported value makes the return that."""
    return (f"named_struct('base', {fold_sql('-1', False, d)}.ret, 'nfp', "
            f"transform(filter(sequence(0, n_params), c -> c < n_params), c -> {fold_sql('c', False, d)}.ret = {d.reported}Y))")


def contexts_sql(d: Domain = NULLNESS) -> str:
    """All contexts of a function, index 0 being context -1.

    A parameter whose annotation or default decides its value has it whatever is passed, and parameters come
    first on a tape, so its context is context -1 and is not folded again.
    """
    decided = "exists(tape, t -> t.op = 'param' AND t.slot = c AND t.ann <> 0Y)"
    return _let("b", fold_sql("-1", True, d),
                f"transform(sequence(-1, n_params - 1), c -> if(c = -1 OR {decided}, b, {fold_sql('c', True, d)}))")
