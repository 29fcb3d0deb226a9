"""Queries over the programs derived from line items, one module each.

The SQL checks never parse anything: they recompute every result from the table's columns by case
analysis of the module template, find spans with ``strpos`` in the text they build themselves, and
follow calls with recursive queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.functions.lattice import value_name
from deflow.operators import cfg, facts, reaching
from deflow.operators.diff import blast_radius, diff
from deflow.operators.shaping import consumers, findings, placed_findings, with_root
from deflow.operators.solver import KEY, Solved, definitions, intraprocedural, place, solve
from deflow.operators.witness import trim_witness, witnesses
from deflow.plans import workspace
from deflow.plans.registry import query
from deflow.session import cut
from deflow.sources.code import changed_files, content_hash, parse_sources, read_tapes, read_unknowns
from deflow.sources.derived import CALLEE, EDITED, HELPER, NAME, QUANTITY, RECV, URI, line_modules, module_sql

_CACHE: dict[tuple, object] = {}


def _once(spark: SparkSession, key: tuple, build):
    """Share a materialised intermediate between queries of one session."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


def forget() -> None:
    """Drop shared intermediates, for timing queries one by one."""
    _CACHE.clear()


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_sources(line_modules(spark, sf_dir))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, ("placed", sf_dir), lambda: place(read_tapes(line_modules(spark, sf_dir))))


def told(spark: SparkSession, key: tuple, modules: DataFrame) -> DataFrame:
    """Tapes for queries over facts alone. They need no context, no place and no kept copy, so they are read
    straight from the text, unless an analysis of this session has left them placed under ``key`` already."""
    kept = _CACHE.get((spark.sparkContext.applicationId, *key))
    return kept if kept is not None else read_tapes(modules)


def tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, ("placed", sf_dir), line_modules(spark, sf_dir))


def solved(spark: SparkSession, sf_dir: str, scope: str = "workspace") -> Solved:
    return _once(spark, ("solved", sf_dir, scope), lambda: solve(placed(spark, sf_dir), scope))


def solved_edited(spark: SparkSession, sf_dir: str) -> Solved:
    """The state after the edit, from the state before: only files with other content are read again."""
    def build():
        before = line_modules(spark, sf_dir).select("ws", "uri", content_hash("text").alias("sha"))
        edits = changed_files(line_modules(spark, sf_dir, edited=True), before)
        return workspace.edited(workspace.Workspace(placed(spark, sf_dir), solved(spark, sf_dir)), edits.drop("sha")).solved
    return _once(spark, ("edited", sf_dir), build)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, ("reports", sf_dir), lambda: cut(witnesses(solved(spark, sf_dir))))


# -- SQL model of the module template ------------------------------------------------------------

def _ret(a: str, b: str, v: str, p: str = "") -> str:
    """Value returned, given a, b and v as 1 unknown, 2 non-null, 3 nullable."""
    after = f"(CASE WHEN {p}broken THEN 1 ELSE {v} END)"
    guarded = f"(CASE {p}g WHEN 1 THEN 1 WHEN 2 THEN (CASE WHEN {after} = 2 THEN 2 ELSE 1 END) ELSE {after} END)"
    return f"(CASE WHEN {p}ret_v THEN {guarded} ELSE (CASE WHEN {p}broken THEN 1 ELSE {b} END) END)"


def _v(a: str, b: str, p: str = "", s: str = "s.") -> str:
    """Value of v right after its assignment, with the callee's summary in ``s`` (nulls: unresolved)."""
    call = (f"(CASE WHEN {s}base IS NULL THEN 1 WHEN ({b} = 3 AND {s}n0) OR ({a} = 3 AND {s}n1) THEN 3 ELSE {s}base END)")
    return f"(CASE {p}rf WHEN 'A' THEN 3 WHEN 'N' THEN {a} ELSE {call} END)"


def model(quantity: str = QUANTITY, tag: str = "", scope: str = "workspace") -> str:
    """CTEs ``src`` (modules), ``sm`` (summaries), ``seen`` (reached contexts) and ``regs``."""
    name, callee, helper, uri = (x.format(s="varchar") for x in (NAME, CALLEE, HELPER, URI))
    only = "" if scope == "workspace" else " AND f.name = u.name"
    kids = []
    for ctx, a, b in ((-1, "1", "f.b0"), (0, "3", "f.b0"), (1, "1", "3")):
        kids.append(f"SELECT f.*, {ctx} AS ctx, {a} AS a, {b} AS b, {_v(a, b, 'f.')} AS v FROM f{tag} f LEFT JOIN sm{tag} s ON s.uri = f.c_uri")
    per_ctx = " UNION ALL ".join(kids)
    step = f"""SELECT f.uri, f.name, {_ret('1', 'f.b0', _v('1', 'f.b0', 'f.'), 'f.')},
        {_ret('3', 'f.b0', _v('3', 'f.b0', 'f.'), 'f.')} = 3, {_ret('1', '3', _v('1', '3', 'f.'), 'f.')} = 3"""
    zero = f"""SELECT f.uri, f.name, {_ret('1', 'f.b0', _v('1', 'f.b0', 'f.', 'z.'), 'f.')} AS base,
        {_ret('3', 'f.b0', _v('3', 'f.b0', 'f.', 'z.'), 'f.')} = 3 AS n0, {_ret('1', '3', _v('1', '3', 'f.', 'z.'), 'f.')} = 3 AS n1"""
    return f"""src{tag} AS (SELECT *, {uri} AS uri, {name} AS name, {module_sql('varchar', quantity)} AS text,
    l_returnflag AS rf, {quantity} % 4 AS g, {quantity} % 10 = 9 AS broken, l_partkey % 2 = 0 AS ret_v,
    CASE WHEN l_linestatus = 'F' THEN 3 ELSE 1 END AS b0, {callee} AS callee, {helper} AS helper,
    l_discount > 0.05 AS helps, {RECV} AS recv FROM lineitem),
uq{tag} AS (SELECT name, min(uri) AS uri FROM src{tag} GROUP BY name HAVING count(*) = 1),
f{tag} AS (SELECT f.*, u.uri AS c_uri, h.uri AS h_uri FROM src{tag} f
    LEFT JOIN uq{tag} u ON u.name = f.callee AND f.rf = 'R'{only}
    LEFT JOIN uq{tag} h ON h.name = f.helper AND f.helps{only.replace('u.', 'h.')}),
sm{tag} AS (
    {zero} FROM f{tag} f JOIN (SELECT CAST(NULL AS INTEGER) AS base, FALSE AS n0, FALSE AS n1) z ON TRUE
      WHERE f.c_uri IS NULL OR f.c_uri = f.uri
    UNION ALL
    {step} FROM f{tag} f JOIN sm{tag} s ON s.uri = f.c_uri AND f.c_uri <> f.uri),
cx{tag} AS (SELECT *,
    CASE WHEN broken THEN 1 ELSE v END AS v1, CASE WHEN broken THEN 1 ELSE a END AS a1 FROM ({per_ctx})),
cy{tag} AS (SELECT *, CASE g WHEN 1 THEN 1 WHEN 2 THEN (CASE WHEN v1 = 2 THEN 2 ELSE 1 END) ELSE v1 END AS v2,
    CASE WHEN g = 3 THEN 2 ELSE a1 END AS a2, recv = 'a.' AND (NOT broken OR g = 3) AS blocked FROM cx{tag}),
ed{tag} AS (
    SELECT uri, ctx, c_uri, 0 AS c_ctx FROM cy{tag} WHERE c_uri IS NOT NULL AND b = 3
    UNION SELECT uri, ctx, c_uri, 1 FROM cy{tag} WHERE c_uri IS NOT NULL AND a = 3
    UNION SELECT uri, ctx, h_uri, 0 FROM cy{tag} WHERE h_uri IS NOT NULL AND NOT blocked AND v2 = 3
    UNION SELECT uri, ctx, h_uri, 1 FROM cy{tag} WHERE h_uri IS NOT NULL AND NOT blocked),
seen{tag} AS (
    SELECT c_uri AS uri, c_ctx AS ctx FROM ed{tag} WHERE ctx = -1
    UNION SELECT e.c_uri, e.c_ctx FROM seen{tag} s JOIN ed{tag} e ON e.uri = s.uri AND e.ctx = s.ctx),
live{tag} AS (SELECT c.* FROM cy{tag} c WHERE ctx = -1 UNION ALL SELECT c.* FROM cy{tag} c JOIN seen{tag} s ON s.uri = c.uri AND s.ctx = c.ctx),
hits{tag} AS (
    SELECT uri, name, text, 'a' AS symbol, 'a.x' AS code, 3 AS len FROM live{tag} WHERE g = 2 AND a1 = 3
    UNION SELECT uri, name, text, 'v', 'v.y', 3 FROM live{tag} WHERE g = 2 AND v1 = 3
    UNION SELECT uri, name, text, 'v', 'v.run', 5 FROM live{tag} WHERE v2 = 3
    UNION SELECT uri, name, text, 'a', concat('a.', helper), 2 + length(helper) FROM live{tag} WHERE helps AND recv = 'a.' AND a2 = 3),
regs{tag} AS (SELECT DISTINCT uri, name AS func_name, symbol, 'attribute' AS kind,
    strpos(text, code) - 1 AS start_byte, strpos(text, code) - 1 + len AS end_byte FROM hits{tag})"""


MODEL = "WITH RECURSIVE " + model()
BOTH = MODEL + ", " + model(EDITED, "2")
_REG = ["uri", "func_name", "symbol", "kind", "start_byte", "end_byte"]


@query("program_regressions", MODEL + " SELECT uri, func_name, symbol, kind, start_byte, end_byte FROM regs")
def q_program_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).regressions.select(*_REG)


@query("program_regressions_by_function", MODEL + """ SELECT s.uri, s.name AS func_name, count(r.uri) AS n_regressions
FROM src s LEFT JOIN regs r ON r.uri = s.uri GROUP BY s.uri, s.name""")
def q_regressions_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = solved(spark, sf_dir)
    per = s.regressions.groupBy(*KEY).count()
    return s.functions.select(*KEY, "func_name").join(per, KEY, "left").select(
        "uri", "func_name", F.coalesce("count", F.lit(0)).alias("n_regressions"))


@query("program_file_regressions", "WITH RECURSIVE " + model(scope="file") + " SELECT uri, func_name, symbol, kind, start_byte, end_byte FROM regs")
def q_file_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls resolve inside their own file only."""
    return solved(spark, sf_dir, scope="file").regressions.select(*_REG)


@query("program_intraprocedural", MODEL + """, i AS (SELECT *, CASE WHEN rf = 'A' AND NOT broken THEN 3 ELSE 1 END AS w FROM src),
h AS (SELECT uri, name, text, 'v.y' AS code, 3 AS len FROM i WHERE g = 2 AND w = 3
      UNION ALL SELECT uri, name, text, 'v.run', 5 FROM i WHERE w = 3 AND g IN (0, 3))
SELECT uri, name AS func_name, 'v' AS symbol, 'attribute' AS kind, strpos(text, code) - 1 AS start_byte, strpos(text, code) - 1 + len AS end_byte FROM h""")
def q_intraprocedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intraprocedural(tapes(spark, sf_dir)).select(*_REG)


@query("program_summaries", MODEL + """ SELECT s.uri, s.name AS func_name,
  CASE m.base WHEN 3 THEN 'Nullable' WHEN 2 THEN 'NonNull' ELSE 'Unknown' END AS base_return, m.n0 AS from_first, m.n1 AS from_second
FROM src s JOIN sm m ON m.uri = s.uri""")
def q_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).summaries.select(
        "uri", "func_name", value_name(F.col("base")).alias("base_return"),
        F.expr("nfp[0]").alias("from_first"), F.expr("nfp[1]").alias("from_second"))


@query("program_contexts", MODEL + " SELECT uri, ctx AS parameter FROM seen")
def q_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that some call may pass None to."""
    return solved(spark, sf_dir).reached.select("uri", F.col("ctx").alias("parameter"))


@query("program_unique_names", MODEL + " SELECT name AS func_name, uri FROM uq")
def q_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that resolve: defined exactly once in the workspace."""
    return definitions(tapes(spark, sf_dir), "workspace").select(F.col("callee").alias("func_name"), F.col("c_uri").alias("uri"))


@query("program_call_resolution", MODEL + """ SELECT uri, callee, c_uri AS target FROM f WHERE c_uri IS NOT NULL
UNION SELECT uri, helper, h_uri FROM f WHERE h_uri IS NOT NULL""")
def q_call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).links.select("uri", "callee", F.col("c_uri").alias("target"))


@query("program_arguments", MODEL + """ SELECT uri, callee, 0 AS position, 'b' AS argument FROM src WHERE rf = 'R'
UNION ALL SELECT uri, callee, 1, 'a' FROM src WHERE rf = 'R'
UNION ALL SELECT uri, 'run', 0, 'b' FROM src
UNION ALL SELECT uri, helper, 0, 'v' FROM src WHERE helps UNION ALL SELECT uri, helper, 1, 'None' FROM src WHERE helps""")
def q_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional arguments of every named call."""
    t = tapes(spark, sf_dir).select("uri", "syms", "callees", F.explode("tape").alias("t")).where("t.r.k = 'call'")
    return t.select("uri", F.expr("callees[t.r.callee]").alias("callee"), "syms", F.posexplode("t.r.args").alias("position", "a")).select(
        "uri", "callee", "position",
        F.expr("CASE a WHEN -1 THEN 'None' WHEN -2 THEN 'literal' WHEN -3 THEN 'unknown' ELSE syms[a] END").alias("argument"))


@query("program_call_edges", MODEL + """ SELECT uri, strpos(text, '    v = ') + 3 AS start_byte, strpos(text, '    v = ') + 4 AS end_byte, callee, 'Definite' AS confidence
FROM src WHERE rf = 'R'
UNION SELECT uri, strpos(text, concat(helper, '(v, None)')) - 1, strpos(text, concat(helper, '(v, None)')) - 1 + length(helper) + 9, helper, 'Definite'
FROM src WHERE helps AND recv = ''""")
def q_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaching.call_edges(tapes(spark, sf_dir)).drop("ws")


_DEFS = """, u AS (
  SELECT uri, text, strpos(text, '(a, b=') AS p, 'a' AS s, strpos(text, '    v = a') + 7 AS u, rf = 'N' AS ok, FALSE AS late FROM src
  UNION ALL SELECT uri, text, strpos(text, '(a, b=') + 3, 'b', strpos(text, '(b, a)'), rf = 'R', FALSE FROM src
  UNION ALL SELECT uri, text, strpos(text, '(a, b='), 'a', strpos(text, '(b, a)') + 3, rf = 'R', FALSE FROM src
  UNION ALL SELECT uri, text, strpos(text, '    v = ') + 3, 'v', strpos(text, '    v.run') + 3, NOT broken AND g IN (0, 3), TRUE FROM src
  UNION ALL SELECT uri, text, strpos(text, '(a, b=') + 3, 'b', strpos(text, 'v.run(b)') + 5, NOT broken AND g IN (0, 3), TRUE FROM src
  UNION ALL SELECT uri, text, strpos(text, '    v = ') + 3, 'v', strpos(text, '(v, None)'), helps AND NOT broken AND g IN (0, 3), TRUE FROM src
  UNION ALL SELECT uri, text, strpos(text, '(a, b='), 'a', strpos(text, concat('    a.', helper)) + 3, helps AND recv = 'a.' AND NOT broken AND g IN (0, 3), TRUE FROM src
  UNION ALL SELECT uri, text, strpos(text, '    v = ') + 3, 'v', strpos(text, '    return v') + 10, ret_v AND NOT broken AND g IN (0, 3), TRUE FROM src
  UNION ALL SELECT uri, text, strpos(text, '(a, b=') + 3, 'b', strpos(text, '    return b') + 10, NOT ret_v AND NOT broken AND g IN (0, 3), TRUE FROM src)
SELECT uri, s AS symbol, p AS def_start, u AS use_start, 'Definite' AS confidence FROM u WHERE ok"""


@query("program_def_use", MODEL + _DEFS)
def q_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Def-use edges; branches and broken statements are barriers, so uses behind them have none."""
    return facts.def_use_edges(parsed(spark, sf_dir)).select(
        "uri", "symbol", F.col("def_node.start_byte").alias("def_start"), F.col("use_node.start_byte").alias("use_start"), "confidence")


@query("program_value_flow", MODEL + _DEFS.replace("SELECT uri, s AS symbol, p AS def_start, u AS use_start, 'Definite' AS confidence FROM u WHERE ok",
       "SELECT DISTINCT uri, u AS start_byte FROM u WHERE ok AND s = 'v'"))
def q_program_value_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses reached by the definition of v, asked for by byte position in every module."""
    edges = facts.def_use_edges(parsed(spark, sf_dir))
    asked = line_modules(spark, sf_dir).select("ws", "uri", (F.instr("text", "    v = ") + 3).cast("long").alias("position"))
    return reaching.value_flow(edges, asked, ["ws", "uri"], "forward").select("uri", "start_byte")


@query("program_facts", MODEL + """ SELECT uri, 2 + (1) + (CASE WHEN rf = 'R' THEN 1 ELSE 0 END) + (CASE WHEN broken THEN 1 ELSE 0 END)
  + CASE g WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 0 END + 2 + (CASE WHEN helps THEN 2 ELSE 0 END) + 1 AS n_facts FROM src""")
def q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and region markers per function."""
    return tapes(spark, sf_dir).groupBy("uri").agg(F.sum(F.size("tape")).alias("n_facts"))


@query("program_barriers", MODEL + """ SELECT uri, strpos(text, 'z v') - 1 AS start_byte, strpos(text, 'z v') + 2 AS end_byte FROM src WHERE broken""")
def q_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable statements inside functions: certainty is lost there, the rest of the file is kept."""
    marks = F.explode(F.filter("tape", lambda t: t["op"] == "barrier")).alias("t")
    return tapes(spark, sf_dir).select("uri", marks).select("uri", F.col("t.s").alias("start_byte"), F.col("t.e").alias("end_byte"))


@query("program_file_unknowns", MODEL + " SELECT uri, 0 AS start_byte, 0 AS end_byte FROM src WHERE FALSE")
def q_file_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_unknowns(line_modules(spark, sf_dir)).select("uri", "start_byte", "end_byte")


# Path of kinds per witness: each hop is (callee, depth); v comes from its own assignment.
_PATHS = """, why AS (
  SELECT r.uri AS start_uri, r.start_byte, r.symbol, r.uri, r.symbol AS sym, 8 AS depth, CAST('' AS VARCHAR) AS path, 0 AS n, FALSE AS done,
         CAST(NULL AS VARCHAR) AS root_uri, CAST(NULL AS VARCHAR) AS root_symbol FROM regs r
  UNION ALL
  SELECT w.start_uri, w.start_byte, w.symbol,
    CASE WHEN w.depth > 0 AND w.sym = 'v' AND f.rf = 'R' AND s.base = 3 AND w.depth > 1 THEN f.c_uri ELSE w.uri END,
    CASE WHEN w.sym = 'v' AND f.rf = 'R' AND s.base = 3 THEN (CASE WHEN c.ret_v THEN 'v' ELSE 'b' END)
         WHEN w.sym = 'v' AND f.rf = 'R' THEN (CASE WHEN s.n0 THEN 'b' ELSE 'a' END)
         WHEN w.sym = 'v' AND f.rf = 'N' THEN 'a' ELSE w.sym END,
    CASE WHEN w.sym = 'v' AND f.rf = 'N' THEN w.depth - 1 ELSE w.depth - 2 END,
    CASE WHEN w.depth <= 0 THEN concat('opaque,', w.path)
         WHEN w.sym <> 'v' THEN concat('nullable_param,', w.path)
         WHEN f.rf = 'A' THEN concat('none_assignment,', w.path)
         WHEN f.rf = 'N' THEN concat('variable_copy,', w.path)
         WHEN w.depth = 1 THEN concat('opaque,call_return,', w.path)
         ELSE concat('call_return,', w.path) END,
    w.n + (CASE WHEN w.depth = 1 AND w.sym = 'v' AND f.rf = 'R' THEN 2 ELSE 1 END),
    w.depth <= 0 OR w.sym <> 'v' OR f.rf = 'A' OR (w.depth = 1 AND f.rf = 'R'),
    CASE WHEN w.depth > 0 AND (w.sym <> 'v' OR f.rf = 'A') THEN w.uri END,
    CASE WHEN w.depth > 0 AND (w.sym <> 'v' OR f.rf = 'A') THEN w.sym END
  FROM why w JOIN f ON f.uri = w.uri LEFT JOIN sm s ON s.uri = f.c_uri LEFT JOIN src c ON c.uri = f.c_uri WHERE NOT w.done),
wit AS (SELECT start_uri AS uri, start_byte, symbol, concat(path, 'consumer') AS path, n + 1 AS n_steps, root_uri, root_symbol FROM why WHERE done)"""


@query("program_witnesses", MODEL + _PATHS + " SELECT uri, start_byte, symbol, path, n_steps, root_uri FROM wit")
def q_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_root(reports(spark, sf_dir)).select(
        "uri", "start_byte", "symbol", F.array_join(F.transform("witness", lambda s: s["kind"]), ",").alias("path"),
        F.col("witness_len").alias("n_steps"), "root_uri")


@query("program_trimmed_witnesses", MODEL + _PATHS + """ SELECT uri, start_byte, CASE WHEN n_steps <= 3 THEN path
  ELSE concat(split_part(path, ',', 1), ',opaque,consumer') END AS path FROM wit""")
def q_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reports(spark, sf_dir).withColumn("t", trim_witness("witness", 3))
    return t.select("uri", "start_byte", F.array_join(F.transform("t", lambda s: s["kind"]), ",").alias("path"))


_ROOTED = """ SELECT root_uri, root_symbol, count(*) AS n_consumers, 'high' AS confidence FROM wit GROUP BY root_uri, root_symbol"""


@query("program_findings", MODEL + _PATHS + _ROOTED)
def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by root cause over the whole workspace."""
    return findings(with_root(reports(spark, sf_dir)), ["ws"]).select("root_uri", "root_symbol", "n_consumers", "confidence")


@query("program_finding_consumers", MODEL + _PATHS + """ SELECT root_uri, root_symbol, n_steps, count(*) AS n,
  max(rank_in) AS last_rank FROM (SELECT *, row_number() OVER (PARTITION BY root_uri, root_symbol ORDER BY n_steps) AS rank_in FROM wit)
GROUP BY root_uri, root_symbol, n_steps""")
def q_finding_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers of each finding ranked from the shortest witness on, summed up per witness length."""
    c = consumers(with_root(reports(spark, sf_dir)), ["ws"])
    return c.groupBy("root_uri", "root_symbol", F.col("witness_len").alias("n_steps")).agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


@query("program_top_findings", MODEL + _PATHS + """, c AS (SELECT root_uri, root_symbol, count(*) AS n_consumers FROM wit GROUP BY root_uri, root_symbol)
SELECT root_uri, root_symbol, n_consumers, rank() OVER (ORDER BY n_consumers DESC) AS place FROM c""")
def q_top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked report: best confidence, then most consumers; all findings, with their place.

    Places are counted per (confidence, consumers) and summed up over those few levels.
    """
    return placed_findings(findings(with_root(reports(spark, sf_dir)), ["ws"])).select("root_uri", "root_symbol", "n_consumers", "place")


_CHANGES = """, kb AS (SELECT *, row_number() OVER (PARTITION BY uri, func_name, symbol, kind ORDER BY start_byte, end_byte) AS o FROM regs),
ka AS (SELECT *, row_number() OVER (PARTITION BY uri, func_name, symbol, kind ORDER BY start_byte, end_byte) AS o FROM regs2),
ch AS (SELECT 'new' AS change, a.* FROM ka a ANTI JOIN kb b ON a.uri = b.uri AND a.func_name = b.func_name AND a.symbol = b.symbol AND a.kind = b.kind AND a.o = b.o
  UNION ALL SELECT 'fixed', b.* FROM kb b ANTI JOIN ka a ON a.uri = b.uri AND a.func_name = b.func_name AND a.symbol = b.symbol AND a.kind = b.kind AND a.o = b.o)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(solved(spark, sf_dir).regressions, solved_edited(spark, sf_dir).regressions)


@query("program_diff", BOTH + _CHANGES + " SELECT change, uri, func_name, symbol, kind, start_byte, end_byte FROM ch")
def q_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and fixed regressions when a fifth of the modules is edited."""
    return changes(spark, sf_dir).select("change", *_REG)


@query("program_blast_radius", BOTH + _CHANGES + " SELECT DISTINCT start_byte, end_byte FROM ch")
def q_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blast_radius(changes(spark, sf_dir)).select("start_byte", "end_byte")


@query("program_new_findings", "WITH RECURSIVE " + model(EDITED) + ", " + model(QUANTITY, "0") + _PATHS
       + _CHANGES.replace("regs2", "regsX").replace("FROM regs)", "FROM regs0)").replace("regsX", "regs")
       + """ SELECT w.root_uri, w.root_symbol, count(*) AS n_consumers FROM wit w JOIN ch c ON c.change = 'new' AND c.uri = w.uri
  AND c.start_byte = w.start_byte GROUP BY w.root_uri, w.root_symbol""")
def q_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preview of an edit reports: only new regressions are explained and grouped."""
    after = solved_edited(spark, sf_dir)
    fresh = changes(spark, sf_dir).where("change = 'new'")
    return findings(with_root(witnesses(after, fresh)), ["ws"]).select("root_uri", "root_symbol", "n_consumers")


_AFTER = "strpos(text, '    v.run') + 3"


@query("program_control_flow", MODEL + f""", e AS (
  SELECT uri, 'TrueBranch' AS kind, strpos(text, 'if v') + 2 AS from_start, strpos(text, CASE g WHEN 1 THEN 'v.item' ELSE 'a.x' END) - 1 AS to_start FROM src WHERE g IN (1, 2)
  UNION ALL SELECT uri, 'FalseBranch', strpos(text, 'if v') + 2, CASE g WHEN 1 THEN {_AFTER} ELSE strpos(text, 'v.y') - 1 END FROM src WHERE g IN (1, 2)
  UNION ALL SELECT uri, 'Exception', strpos(text, '    v = ') + 3, strpos(text, 'z v') - 1 FROM src WHERE broken)
SELECT uri, kind, from_start, to_start FROM e""")
def q_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of branch and exceptional edges."""
    e = cfg.cfg_edges(tapes(spark, sf_dir)).where("kind <> 'Seq'")
    return e.select("uri", "kind", F.col("a_start").alias("from_start"), F.col("b_start").alias("to_start"))


@query("program_parameter_types", MODEL + """ SELECT uri, 'b' AS symbol, 'Nullable' AS nullability FROM src WHERE l_linestatus = 'F'""")
def q_parameter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.type_facts(tapes(spark, sf_dir)).where("op = 'param'").select("uri", "symbol", "nullability")


@query("program_flow_nodes", MODEL + """ SELECT role, CAST(sum(n) AS BIGINT) AS n_nodes FROM (
  SELECT 'source' AS role, (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + (CASE WHEN rf = 'A' THEN 1 ELSE 0 END) AS n FROM src
  UNION ALL SELECT 'transfer', CASE WHEN rf = 'A' THEN 0 ELSE 1 END FROM src
  UNION ALL SELECT 'consumer', 1 + (CASE WHEN rf = 'R' THEN 1 ELSE 0 END) + CASE g WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END
     + (CASE WHEN helps THEN 1 ELSE 0 END) FROM src) GROUP BY role""")
def q_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.value_flow_nodes(tapes(spark, sf_dir)).groupBy("role").agg(F.count(F.lit(1)).alias("n_nodes"))
