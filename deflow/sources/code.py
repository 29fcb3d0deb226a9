"""Source files as a DataFrame, and the narrow map from text to functions of syntax nodes."""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.functions import annotations
from deflow.session import spread
from deflow.sources import syntax
from deflow.sources import tape as tape_of
from deflow.sources.syntax import read_functions

# Executors need no installed copy of this package: the parse helper travels with the task.
cloudpickle.register_pickle_by_value(syntax)
cloudpickle.register_pickle_by_value(tape_of)
cloudpickle.register_pickle_by_value(annotations)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = ("struct<kind:string,role:string,name:string,s:int,e:int,ctx:string,top:int,up:int,"
        "kids:array<int>,size:int,slot:int>")
FUNCTION_DDL = (f"ws string, uri string, fn int, func_name string, func_start int, func_end int, nodes array<{NODE}>")
_TYPES = dict(kind=pa.string(), role=pa.string(), name=pa.string(), s=pa.int32(), e=pa.int32(), ctx=pa.string(),
              top=pa.int32(), up=pa.int32(), kids=pa.list_(pa.int32()), size=pa.int32(), slot=pa.int32())


_RHS = dict(k=pa.string(), v=pa.int8(), s=pa.int32(), callee=pa.int32(), recv=pa.int32(), args=pa.list_(pa.int32()))
_COND = dict(s=pa.int32(), t=pa.int8(), f=pa.int8(), refs=pa.list_(pa.int32()))
_EVENT = dict(ord=pa.int64(), op=pa.string(), s=pa.int32(), e=pa.int32(), slot=pa.int32(), kind=pa.string(), ann=pa.int8(),
              r=_RHS, c=_COND, bound=pa.list_(pa.int32()))
TAPE_DDL = ("ws string, uri string, fn int, func_name string, func_start int, func_end int, n_params int, syms array<string>, "
            "callees array<string>, tape array<struct<ord:bigint,op:string,s:int,e:int,slot:int,kind:string,ann:tinyint,"
            "r:struct<k:string,v:tinyint,s:int,callee:int,recv:int,args:array<int>>,c:struct<s:int,t:tinyint,f:tinyint,refs:array<int>>,"
            "bound:array<int>>>")


def _struct(rows: list, types: dict) -> pa.StructArray:
    """Tuples as one columnar array; None is a null struct."""
    nothing = (None,) * len(types)
    fields = list(zip(*(nothing if r is None else r for r in rows))) or [()] * len(types)
    arrays = [_struct(c, t) if isinstance(t, dict) else pa.array(c, type=t) for c, t in zip(fields, types.values())]
    nulls = pa.array([r is None for r in rows], type=pa.bool_())
    return pa.StructArray.from_arrays(arrays, names=list(types), mask=nulls)


def _tape_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Function rows with their tapes as one columnar batch."""
    ws, uri, fn, name, start, end, nodes = zip(*rows)
    n_params, syms, callees, tapes = zip(*map(tape_of.tape, nodes))
    ends = [0]
    for t in tapes:
        ends.append(ends[-1] + len(t))
    as_int, names = (lambda c: pa.array(c, type=pa.int32())), pa.list_(pa.string())
    text = lambda c: pa.array(c, type=pa.string())
    events = pa.ListArray.from_arrays(as_int(ends), _struct([x for t in tapes for x in t], _EVENT))
    return pa.RecordBatch.from_arrays(
        [text(ws), text(uri), as_int(fn), text(name), as_int(start), as_int(end), as_int(n_params), pa.array(syms, type=names),
         pa.array(callees, type=names), events],
        names=["ws", "uri", "fn", "func_name", "func_start", "func_end", "n_params", "syms", "callees", "tape"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Function rows as one columnar batch; node fields are transposed instead of boxed one by one."""
    ws, uri, fn, name, start, end, nodes = zip(*rows)
    ends = [0]
    for n in nodes:
        ends.append(ends[-1] + len(n))
    flat = list(zip(*(x for n in nodes for x in n))) or [()] * len(_TYPES)
    fields = [pa.array(c, type=t) for c, t in zip(flat, _TYPES.values())]
    struct = pa.StructArray.from_arrays(fields, names=list(_TYPES))
    as_int = lambda c: pa.array(c, type=pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(ws, type=pa.string()), pa.array(uri, type=pa.string()), as_int(fn), pa.array(name, type=pa.string()),
         as_int(start), as_int(end), pa.ListArray.from_arrays(as_int(ends), struct)],
        names=["ws", "uri", "fn", "func_name", "func_start", "func_end", "nodes"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for ws, uri, text in zip(*(batch.column(c).to_pylist() for c in ("ws", "uri", "text"))):
        functions, errors = read_functions(text or "")
        for i, f in enumerate(functions):
            yield ws, uri, i, f["name"], f["s"], f["e"], f["nodes"]
        for i, (s, e) in enumerate(errors):
            yield ws, uri, -1 - i, None, s, e, []


def _tapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts to batches of functions with their tapes."""
    return _parse(batches, _tape_batch, lambda fn: fn >= 0)


def _parse(batches: Iterator[pa.RecordBatch], made=_batch, only=lambda fn: True) -> Iterator[pa.RecordBatch]:
    """Batches of texts to batches of functions and unreadable regions, ``made`` of those that ``only`` lets through.

    Syntax trees hold no cycles and are freed by their counts, but each makes enough objects to set off the
    collector, which then walks all rows held: it took half of the parser's time. It pauses while a batch is read.
    """
    for batch in batches:
        on = gc.isenabled()
        gc.disable()
        try:
            rows: list[tuple] = []
            for row in _rows(batch):
                if not only(row[2]):
                    continue
                rows.append(row)
                if len(rows) >= 500:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)
        finally:
            if on:
                gc.enable()


def parse_sources(sources: DataFrame) -> DataFrame:
    """One row per root function (``fn`` >= 0) or unreadable root region (``fn`` < 0).

    Text is dealt evenly once; function rows come out in the task that reads it.
    """
    return spread(sources.select("ws", "uri", "text"), "ws", "uri").mapInArrow(_parse, FUNCTION_DDL)


def read_tapes(sources: DataFrame) -> DataFrame:
    """One row per root function with its tape, as ``facts.tapes(parse_sources(sources))`` without its nodes."""
    return spread(sources.select("ws", "uri", "text"), "ws", "uri").mapInArrow(_tapes, TAPE_DDL)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts to their unreadable root regions; functions are left where they were read."""
    for found in _parse(batches, only=lambda fn: fn < 0):
        yield found.select(["ws", "uri", "func_start", "func_end"]).rename_columns(["ws", "uri", "start_byte", "end_byte"])


def read_unknowns(sources: DataFrame) -> DataFrame:
    """Unreadable regions at file level, as ``file_unknowns(parse_sources(sources))``."""
    found = spread(sources.select("ws", "uri", "text"), "ws", "uri").mapInArrow(_regions, "ws string, uri string, start_byte int, end_byte int")
    return found.withColumn("reason", F.lit("parse error at module level"))


def file_unknowns(parsed: DataFrame) -> DataFrame:
    """Unreadable regions at file level."""
    return parsed.where("fn < 0").select(
        "ws", "uri", F.col("func_start").alias("start_byte"), F.col("func_end").alias("end_byte"),
        F.lit("parse error at module level").alias("reason"))


def read_python_tree(spark: SparkSession, root: str, ws: str = "ws", max_files: int | None = None) -> DataFrame:
    """``*.py`` files below ``root`` without hidden folders, ``node_modules`` and ``__pycache__``.

    Only folders below ``root`` are looked at, wherever it lies. Bytes that are no UTF-8 become U+FFFD,
    and ``valid`` tells. ``max_files`` is the repository listing's own bound (the first files by path); ``None`` reads all.
    """
    place = re.sub(r"^[a-zA-Z][\w+.-]*:/*", "/", root).rstrip("/")
    below = F.substr("path", F.instr(F.col("path"), place) + F.lit(len(place)))
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
        .where(~below.rlike(r"/(\.[^/]+|node_modules|__pycache__)/"))
        .select(F.lit(ws).alias("ws"), F.col("path").alias("uri"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
                F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    )
    return df.orderBy("uri").limit(max_files) if max_files is not None else df


def changed_files(current: DataFrame, registered: DataFrame) -> DataFrame:
    """Files whose content hash is not the one registered for their uri."""
    now = current.withColumn("sha", content_hash("text"))
    return now.join(registered.select("ws", "uri", "sha"), ["ws", "uri", "sha"], "left_anti")


def content_hash(col: str):
    return F.md5(F.col(col))


def upsert_files(current: DataFrame, edits: DataFrame) -> DataFrame:
    """Full-text upsert by ``(ws, uri)``; of several edits to one file the highest ``rev`` wins.

    ``max_by`` combines map-side, so many edits of one file do not meet in one task.
    """
    both = current.select("ws", "uri", "text", "rev").unionByName(edits.select("ws", "uri", "text", "rev"))
    return both.groupBy("ws", "uri").agg(F.max_by("text", "rev").alias("text"), F.max("rev").alias("rev"))
