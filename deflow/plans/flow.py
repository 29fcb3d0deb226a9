"""Queries over the event fact stream: users are functions, events are ordered facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.functions.lattice import DOMAINS, join_all, value_name
from deflow.operators.prefix import segment_width
from deflow.operators.reaching import epochs, last_definitions, reaching_defs, value_flow
from deflow.operators.skew import rank_in_group
from deflow.plans.registry import query
from deflow.sources.derived import event_facts, event_order, table

EV = """WITH ev AS (
  SELECT user_id AS func, ts, event_id AS node,
         CASE event_type WHEN 'signup' THEN 'def' WHEN 'purchase' THEN 'def' WHEN 'error' THEN 'unknown' ELSE 'use' END AS tag,
         event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 5 AS symbol,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
         CASE WHEN value < 20 THEN 3 ELSE 2 END AS def_value,
         CASE WHEN (CASE WHEN event_id % 7 = 0 THEN value + 15 ELSE value END) < 20 THEN 3 ELSE 2 END AS edited_value
  FROM events),
ep AS (SELECT *, coalesce(sum(CASE WHEN tag = 'unknown' THEN 1 ELSE 0 END) OVER (
         PARTITION BY func ORDER BY ts, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM ev),
ld AS (SELECT *,
         last_value(CASE WHEN tag = 'def' THEN node END IGNORE NULLS) OVER w AS def_node,
         last_value(CASE WHEN tag = 'def' THEN def_value END IGNORE NULLS) OVER w AS src,
         last_value(CASE WHEN tag = 'def' THEN edited_value END IGNORE NULLS) OVER w AS edited_src,
         last_value(CASE WHEN tag = 'def' THEN k END IGNORE NULLS) OVER w AS def_k
       FROM ep WHERE tag <> 'unknown'
       WINDOW w AS (PARTITION BY func, epoch, symbol ORDER BY ts, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
regs AS (SELECT func, node, symbol, 'subscript' AS kind FROM ld WHERE event_type = 'view' AND src = 3),
after_regs AS (SELECT func, node, symbol, 'subscript' AS kind FROM ld WHERE event_type = 'view' AND edited_src = 3)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event facts with the flow tags; views and clicks are uses, views also dereferences."""
    tag = F.when(F.col("tag").isin("param", "assign"), "def").when(F.col("tag") == "barrier", "unknown").otherwise("use")
    return event_facts(spark, sf_dir).withColumn("consumer", F.col("tag") == "consumer").withColumn("tag", tag)


def _width(df: DataFrame) -> int:
    return segment_width(df, ["func"], event_order().position)


@query("reaching_defs", EV + "SELECT func, symbol, def_node, node AS use_node, CASE WHEN epoch > 0 THEN 'Unknown' ELSE 'Definite' END AS confidence FROM ld WHERE tag = 'use' AND def_node IS NOT NULL")
def q_reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir).select("func", "ts", "node", "tag", "symbol")
    return reaching_defs(d, ["func"], event_order(), F.col("node"), _width(d))


@query("barrier_epochs", EV + "SELECT func, CAST(epoch AS BIGINT) AS epoch, count(*) AS n_facts FROM ep GROUP BY func, epoch")
def q_barrier_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts(spark, sf_dir).select("func", "ts", "node", "tag")
    return epochs(d, ["func"], event_order(), _width(d)).groupBy("func", F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("n_facts"))


def _spanned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose nodes are spans of 4 to 7 positions inside each event's own slot of 8."""
    d = facts(spark, sf_dir).select("func", "ts", "node", "tag", "symbol", "k")
    start = F.col("node") * 8
    return reaching_defs(d, ["func"], event_order(), F.struct(
        start.alias("start_byte"), (start + 4 + F.col("k") % 4).alias("end_byte")), _width(d))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("func"), (F.col("event_id") * 8 + 5).alias("position"))


_BACK = "SELECT func, node * 8 + 5 AS position, def_node * 8 AS start_byte, def_node * 8 + 4 + def_k % 4 AS end_byte FROM ld WHERE tag = 'use' AND def_node IS NOT NULL AND 5 < 4 + k % 4"
_FWD = "SELECT func, def_node * 8 + 5 AS position, node * 8 AS start_byte, node * 8 + 4 + k % 4 AS end_byte FROM ld WHERE tag = 'use' AND def_node IS NOT NULL AND 5 < 4 + def_k % 4"


@query("value_flow_backward", EV + _BACK)
def q_value_flow_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_flow(_spanned_edges(spark, sf_dir), _positions(spark, sf_dir), ["func"], "backward")


@query("value_flow_forward", EV + _FWD)
def q_value_flow_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_flow(_spanned_edges(spark, sf_dir), _positions(spark, sf_dir), ["func"], "forward")


@query("value_flow_both", EV + f"SELECT * FROM ({_BACK}) UNION SELECT * FROM ({_FWD})")
def q_value_flow_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_flow(_spanned_edges(spark, sf_dir), _positions(spark, sf_dir), ["func"], "both")


def stream_regressions(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """Dereferences whose reaching definition is None, straight-line with barriers."""
    d = facts(spark, sf_dir)
    if edited:
        shifted = F.when(F.col("node") % 7 == 0, F.col("value") + 15).otherwise(F.col("value"))
        d = d.withColumn("def_value", F.when(shifted < 20, 3).otherwise(2))
    d = d.select("func", "ts", "node", "tag", "symbol", "consumer", "def_value")
    found = last_definitions(d, ["func"], event_order(), F.col("def_value"), _width(d))
    return found.where("consumer AND src = 3").select("func", "node", "symbol", F.lit("subscript").alias("kind"))


@query("stream_regressions", EV + "SELECT * FROM regs")
def q_stream_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_regressions(spark, sf_dir)


@query("regression_distinct", EV + "SELECT DISTINCT func, symbol, kind FROM regs")
def q_regression_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_regressions(spark, sf_dir).select("func", "symbol", "kind").distinct()


@query("regressions_by_function", EV + """, fs AS (SELECT DISTINCT user_id AS func FROM events)
SELECT fs.func, count(regs.node) AS n_regressions, min(regs.node) AS first_node, max(regs.node) AS last_node
FROM fs LEFT JOIN regs ON regs.func = fs.func GROUP BY fs.func""")
def q_regressions_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function, also those without a regression; counted before the join, so no list is gathered."""
    per = stream_regressions(spark, sf_dir).groupBy("func").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("func")).distinct()
    return every.join(per, "func", "left").select("func", F.coalesce("n", F.lit(0)).alias("n_regressions"), "first_node", "last_node")


_J = {"definite": "CASE WHEN {a} = {b} THEN {a} ELSE 1 END", "possible": "CASE WHEN {a} = {b} THEN {a} WHEN {a} = 3 OR {b} = 3 THEN 3 ELSE 1 END"}


def _laws_sql() -> str:
    one = lambda d: f"""SELECT '{d}' AS domain, a, b, c, {_J[d].format(a='a', b='b')} AS ab, {_J[d].format(a='b', b='c')} AS bc FROM v"""
    part = lambda d: f"""SELECT domain, ab, a, b, c, {_J[d].format(a='ab', b='c')} AS l, {_J[d].format(a='a', b='bc')} AS r FROM ({one(d)})"""
    return f"""WITH v AS (SELECT CAST(l_linenumber % 4 AS INTEGER) AS a, CAST(l_orderkey % 4 AS INTEGER) AS b, CAST(l_partkey % 4 AS INTEGER) AS c FROM lineitem)
SELECT domain, ab AS joined, count(*) AS n, count(*) FILTER (l = r) AS associative, count(*) AS commutative, count(*) AS idempotent
FROM ({' UNION ALL '.join(part(d) for d in _J)}) GROUP BY domain, ab"""


@query("lattice_laws", _laws_sql())
def q_lattice_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins of values taken from the line items, by domain and result, and for how many of them each law of a lattice holds."""
    v = table(spark, sf_dir, "lineitem").selectExpr(*[f"cast({c} % 4 AS tinyint) AS {n}" for n, c in (("a", "l_linenumber"), ("b", "l_orderkey"), ("c", "l_partkey"))])
    out = None
    for d in DOMAINS:
        j = lambda df, name, a, b, d=d: df.withColumn(name, F.expr(d.join_sql(a, b)))
        t = j(j(j(j(v, "ab", "a", "b"), "ba", "b", "a"), "bc", "b", "c"), "aa", "a", "a")
        t = j(j(t, "l", "ab", "c"), "r", "a", "bc")
        law = lambda c: F.count_if(F.expr(c))
        t = t.groupBy(F.lit(d.name).alias("domain"), F.col("ab").cast("int").alias("joined")).agg(
            F.count(F.lit(1)).alias("n"), law("l = r").alias("associative"), law("ab = ba").alias("commutative"), law("aa = a").alias("idempotent"))
        out = t if out is None else out.unionByName(t)
    return out


@query("lattice_return_join", EV + """SELECT func, symbol,
  CASE WHEN min(def_value) = max(def_value) THEN CASE min(def_value) WHEN 3 THEN 'Nullable' ELSE 'NonNull' END ELSE 'Unknown' END AS joined
FROM ev WHERE tag = 'def' GROUP BY func, symbol""")
def q_lattice_return_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where("tag = 'def'").groupBy("func", "symbol").agg(value_name(join_all(F.col("def_value"))).alias("joined"))


def _ordinals(regs: DataFrame) -> DataFrame:
    """Occurrence numbers per identity; a user may hold any share of the rows, so segments by node."""
    keys = ["func", "symbol", "kind"]
    return rank_in_group(regs, keys, ["node"], F.floor(F.col("node") / 1_000_000), "ordinal")


_DIFF = EV + """, b AS (SELECT *, row_number() OVER (PARTITION BY func, symbol, kind ORDER BY node) AS ordinal FROM regs),
a AS (SELECT *, row_number() OVER (PARTITION BY func, symbol, kind ORDER BY node) AS ordinal FROM after_regs),
d AS (SELECT coalesce(a.func, b.func) AS func, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ordinal, b.ordinal) AS ordinal,
        coalesce(a.node, b.node) AS node, CASE WHEN b.func IS NULL THEN 'new' ELSE 'fixed' END AS change
      FROM a FULL OUTER JOIN b ON a.func = b.func AND a.symbol = b.symbol AND a.kind = b.kind AND a.ordinal = b.ordinal
      WHERE a.func IS NULL OR b.func IS NULL)
"""


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = ["func", "symbol", "kind", "ordinal"]
    b = _ordinals(stream_regressions(spark, sf_dir)).withColumnRenamed("node", "b_node")
    a = _ordinals(stream_regressions(spark, sf_dir, edited=True)).withColumnRenamed("node", "a_node")
    return a.join(b, on, "full_outer").where("a_node IS NULL OR b_node IS NULL").select(
        "func", "symbol", "ordinal", F.coalesce("a_node", "b_node").alias("node"),
        F.when(F.col("b_node").isNull(), "new").otherwise("fixed").alias("change"))


@query("stream_diff", _DIFF + "SELECT func, symbol, ordinal, node, change FROM d")
def q_stream_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_changes(spark, sf_dir)


@query("stream_blast_radius", _DIFF + "SELECT DISTINCT node FROM d")
def q_stream_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_changes(spark, sf_dir).select("node").distinct()
