"""Fact streams and programs that Spark derives from the given tables.

No table holds source code, so every line item becomes one small Python module (a narrow projection,
so their number grows with ``lineitem``) and every event one fact of an ordered, barrier-separated
stream. Both feed the ordinary operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.operators.prefix import Order

# Module text per line item, as one SQL expression understood by Spark and by the SQL check alike.
# {q} is the quantity that selects the guard; an edited snapshot passes a different one.
MODULE = """concat(
  'import m', chr(10), chr(10), 'def ', {name}, '(a, b=', CASE WHEN l_linestatus = 'F' THEN 'None' ELSE '0' END, '):', chr(10),
  '    v = ', CASE l_returnflag WHEN 'A' THEN 'None' WHEN 'N' THEN 'a' ELSE concat({callee}, '(b, a)') END, chr(10),
  CASE WHEN {q} % 10 = 9 THEN concat('    z v', chr(10)) ELSE '' END,
  CASE {q} % 4 WHEN 1 THEN concat('    if v is not None:', chr(10), '        v.item', chr(10))
       WHEN 2 THEN concat('    if v:', chr(10), '        a.x', chr(10), '    else:', chr(10), '        v.y', chr(10))
       WHEN 3 THEN concat('    assert a', chr(10)) ELSE '' END,
  '    v.run(b)', chr(10),
  CASE WHEN l_discount > 0.05 THEN concat('    ', {recv}, {helper}, '(v, None)', chr(10)) ELSE '' END,
  '    return ', CASE WHEN l_partkey % 2 = 0 THEN 'v' ELSE 'b' END, chr(10))"""
NAME = "concat('f_', cast(l_orderkey AS {s}), '_', cast(l_linenumber AS {s}))"
CALLEE = "concat('f_', cast(cast(floor(l_orderkey / 2) AS bigint) AS {s}), '_', cast(l_linenumber AS {s}))"
HELPER = "concat('f_', cast(cast(floor(l_orderkey / 3) AS bigint) AS {s}), '_', cast(l_linenumber AS {s}))"
RECV = "CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'm.' ELSE 'a.' END"
URI = ("concat(cast(l_orderkey AS {s}), '/', cast(l_linenumber AS {s}), '_', cast(l_partkey AS {s}), '_', "
       "cast(l_suppkey AS {s}), '_', cast(cast(round(l_extendedprice * 100) AS bigint) AS {s}), '.py')")
QUANTITY = "cast(l_quantity AS int)"
EDITED = "(cast(l_quantity AS int) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END)"


def module_sql(string: str, quantity: str = QUANTITY) -> str:
    """The module text expression with ``string`` as the engine's text type."""
    part = {"name": NAME, "callee": CALLEE, "helper": HELPER}
    return MODULE.format(q=quantity, recv=RECV, **{k: v.format(s=string) for k, v in part.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_modules(spark: SparkSession, sf_dir: str, edited: bool = False, ws: str = "ws") -> DataFrame:
    """``(ws, uri, text)`` with one module per line item; ``edited`` gives the snapshot after an edit."""
    text = module_sql("string", EDITED if edited else QUANTITY)
    return table(spark, sf_dir, "lineitem").select(
        F.lit(ws).alias("ws"), F.expr(URI.format(s="string")).alias("uri"), F.expr(text).alias("text"))


# Event types as fact kinds.
TAGS = {"signup": "param", "purchase": "assign", "click": "use", "view": "consumer", "error": "barrier"}


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered facts: function = user, order = (ts, event_id), symbol = k mod 5.

    Definitions carry a nullability: values below 20 are None, values from 20 on are not.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("func"), "ts", F.col("event_id").alias("node"), tag.alias("tag"),
        "value", (k % 5).alias("symbol"), F.when(F.col("value") < 20, 3).otherwise(2).alias("def_value"), k.alias("k"))


def event_order() -> Order:
    """Wall-clock seconds as the position: it never falls while ``ts`` rises, whatever the session's zone."""
    day = F.unix_date(F.to_date("ts")).cast("long")
    return Order(day * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"), ["ts", "node"])
