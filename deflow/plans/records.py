"""Experiment queries: labelled failures, paired arms, sweeps, patches and annotations.

Records are derived row by row from the given tables: a document with its label is a failure, an
order is an instance with two arms, a document's lines are a patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deflow.functions import patches
from deflow.functions.annotations import annotation_nullability
from deflow.operators import experiments as ex
from deflow.plans.registry import query
from deflow.sources.code import content_hash, upsert_files
from deflow.sources.derived import table
from deflow.sources.records import anti_resume, seeded_order


def _pick(column: Column, choices: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in choices])[column.cast("int")]


def _case(expr: str, choices: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices)) + " END"


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# -- labelled failures ---------------------------------------------------------------------------

FAIL = f"""WITH fail AS (SELECT d.doc_id AS instance_id, d.source AS repo,
  {_case('d.n_chars % 9', ex.CATEGORIES)} AS category,
  CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.quality = 1 AND l.toxic = 0 THEN 'yes' WHEN l.quality = 1 THEN 'partial' ELSE 'no' END AS would_catch,
  {_case('d.n_chars % 6', ex.PROPERTIES)} AS which_property,
  {_case('length(d.source) % 4', ex.SOURCES)} AS patch_source
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    verdict = (F.when(F.col("quality").isNull(), "unknown").when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes")
               .when(F.col("quality") == 1, "partial").otherwise("no"))
    return d.select(F.col("doc_id").alias("instance_id"), F.col("source").alias("repo"),
                    _pick(F.col("n_chars") % 9, ex.CATEGORIES).alias("category"), verdict.alias("would_catch"),
                    _pick(F.col("n_chars") % 6, ex.PROPERTIES).alias("which_property"),
                    _pick(F.length("source") % 4, ex.SOURCES).alias("patch_source"))


@query("audit_buckets", FAIL + """SELECT category, count(*) AS n, count(*) FILTER (would_catch IN ('yes', 'partial')) AS analyzable,
  count(*) FILTER (would_catch = 'yes') AS yes, count(*) FILTER (would_catch = 'partial') AS partial,
  count(*) FILTER (would_catch = 'no') AS no, count(*) FILTER (would_catch = 'unknown') AS unknown,
  round(count(*) FILTER (would_catch IN ('yes', 'partial')) / CAST(count(*) AS DOUBLE), 6) AS analyzable_rate
FROM fail WHERE category <> 'unlabeled' GROUP BY category""")
def q_audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.audit_buckets(failures(spark, sf_dir)).withColumn("analyzable_rate", r6("analyzable_rate"))


@query("property_votes", FAIL + """SELECT which_property, count(*) AS votes FROM fail
WHERE category <> 'unlabeled' AND would_catch IN ('yes', 'partial') AND which_property <> 'none' GROUP BY which_property""")
def q_property_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.property_votes(failures(spark, sf_dir))


@query("audit_signals", FAIL + f""", lab AS (SELECT * FROM fail WHERE category <> 'unlabeled'),
ana AS (SELECT * FROM lab WHERE would_catch IN ('yes', 'partial')),
votes AS (SELECT which_property AS p, count(*) AS n, {' '.join(['CASE which_property'] + [f"WHEN '{p}' THEN {i}" for i, p in enumerate(ex.PROPERTIES)] + ['END'])} AS o
          FROM ana WHERE which_property <> 'none' GROUP BY which_property)
SELECT (SELECT count(*) FROM fail) AS n_total, (SELECT count(*) FROM lab) AS n_labeled, (SELECT count(*) FROM ana) AS n_analyzable,
  round((SELECT count(*) FROM ana) / CAST((SELECT count(*) FROM lab) AS DOUBLE), 6) AS analyzable_rate,
  coalesce((SELECT p FROM votes ORDER BY n DESC, o LIMIT 1), 'none') AS recommended_property,
  round((SELECT count(*) FROM lab WHERE category = 'misunderstood_intent') / CAST((SELECT count(*) FROM lab) AS DOUBLE), 6) AS misunderstood_fraction,
  (SELECT count(*) FROM lab WHERE category = 'misunderstood_intent') / CAST((SELECT count(*) FROM lab) AS DOUBLE) > 0.40 AS kill_signal,
  round((SELECT count(*) FROM ana WHERE which_property = 'change_consistency') / CAST((SELECT count(*) FROM ana) AS DOUBLE), 6) AS change_consistency_fraction,
  (SELECT count(*) FROM ana WHERE which_property = 'change_consistency') > (SELECT count(*) FROM ana WHERE which_property = 'nullability') AS redirect_signal""")
def q_audit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ex.audit_signals(failures(spark, sf_dir))
    for c in ("analyzable_rate", "misunderstood_fraction", "change_consistency_fraction"):
        s = s.withColumn(c, r6(c))
    return s


@query("filter_failures", FAIL + """SELECT instance_id FROM fail WHERE category <> 'unlabeled' AND would_catch = 'yes' AND patch_source = 'agent_failed'""")
def q_filter_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.filter_failures(failures(spark, sf_dir), labeled_only=True, analyzable_only=True, verdict="yes", source="agent_failed").select("instance_id")


@query("repo_counts", FAIL + "SELECT repo, count(*) AS n FROM fail GROUP BY repo ORDER BY n DESC, repo LIMIT 20")
def q_repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.repo_counts(failures(spark, sf_dir))


_CONF = "CASE WHEN n_chars % 5 = 0 THEN 'high' WHEN n_chars % 5 = 1 THEN 'low' ELSE 'medium' END"


@query("validated_labels", FAIL + f""", x AS (SELECT f.*, {_CONF} AS conf FROM fail f JOIN documents d ON d.doc_id = f.instance_id)
SELECT instance_id, CASE WHEN would_catch IN ('yes', 'partial') AND which_property = 'none' THEN 'other' ELSE which_property END AS which_property,
  concat(CASE WHEN conf <> 'high' THEN concat('[confidence:', conf, '] ') ELSE '' END,
         CASE WHEN would_catch IN ('yes', 'partial') AND which_property = 'none'
              THEN '{ex.PROPERTY_NOTE.replace("'", "''")}' ELSE '' END, repo) AS analysis_note, conf AS tag FROM x""")
def q_validated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instance_id"), F.expr(_CONF).alias("labeler_confidence"))
    d = failures(spark, sf_dir).join(conf, "instance_id").withColumn("analysis_note", F.col("repo"))
    v = d.select("instance_id", *ex.apply_label())
    return v.select("instance_id", "which_property", "analysis_note", ex.confidence_tag().alias("tag"))


@query("seeded_sample", FAIL + "SELECT instance_id FROM fail ORDER BY md5(concat(CAST(instance_id AS VARCHAR), ':42')), instance_id LIMIT 50")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: the same seed always selects the same instances."""
    return seeded_order(failures(spark, sf_dir).select("instance_id"), "instance_id", 42).limit(50)


@query("pending_resume", "SELECT doc_id AS instance_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_pending_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances without a result yet."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("instance_id"))
    return anti_resume(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instance_id")), done)


# -- arms ----------------------------------------------------------------------------------------

ARMS = """WITH res AS (SELECT o_orderkey AS instance_id, o_orderstatus <> 'F' AS g_success, o_orderpriority <> '1-URGENT' AS a_success,
  (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100.0::DOUBLE AS g_cov, (CAST(floor(o_totalprice / 7) AS BIGINT) % 100) / 100.0::DOUBLE AS a_cov,
  CASE WHEN o_orderstatus = 'P' THEN concat('timeout ', o_orderpriority) END AS g_error,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'no patch' END AS a_error FROM orders),
fb AS (SELECT o_orderkey AS instance_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'nullability' WHEN '2-HIGH' THEN 'change_consistency'
  WHEN '3-MEDIUM' THEN 'type_safety' ELSE 'other' END AS property FROM orders WHERE o_orderpriority <> '5-LOW'),
j AS (SELECT r.*, coalesce(fb.property, 'unknown') AS property, CASE fb.property WHEN 'nullability' THEN 'high' WHEN 'change_consistency' THEN 'medium' ELSE 'low' END AS confidence,
  fb.instance_id IS NOT NULL AS has_fb, CASE WHEN g_success THEN g_cov ELSE 0 END AS g, CASE WHEN a_success THEN a_cov ELSE 0 END AS a
  FROM res r LEFT JOIN fb USING (instance_id))
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = lambda c: (F.floor(c).cast("long") % 100) / F.lit(100.0)
    return o.select(
        F.col("o_orderkey").alias("instance_id"), (F.col("o_orderstatus") != "F").alias("g_success"),
        (F.col("o_orderpriority") != "1-URGENT").alias("a_success"), cents(F.col("o_totalprice")).alias("g_cov"),
        cents(F.col("o_totalprice") / 7).alias("a_cov"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("timeout "), "o_orderpriority")).alias("g_error"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "no patch").alias("a_error"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    prop = (F.when(p == "1-URGENT", "nullability").when(p == "2-HIGH", "change_consistency").when(p == "3-MEDIUM", "type_safety").otherwise("other"))
    f = table(spark, sf_dir, "orders").where(p != "5-LOW").select(F.col("o_orderkey").alias("instance_id"), prop.alias("which_property"))
    return f.withColumn("confidence", ex.property_confidence("which_property"))


def _lift_sql(group: str, property_: str) -> str:
    return f"""SELECT {property_} AS property, count(*) AS n, round(avg(g), 6) AS guided_coverage, round(avg(a), 6) AS ablation_coverage,
  round(avg(g) - avg(a), 6) AS coverage_delta, round(avg(g_cov) FILTER (g_success), 6) AS guided_coverage_ok,
  round(avg(a_cov) FILTER (a_success), 6) AS ablation_coverage_ok, count(*) FILTER (g_success) AS guided_success, count(*) FILTER (a_success) AS ablation_success,
  count(*) FILTER (g - a > 0.05) AS guided_wins, count(*) FILTER (a - g > 0.05) AS ablation_wins,
  count(*) - count(*) FILTER (g - a > 0.05) - count(*) FILTER (a - g > 0.05) AS ties,
  count(*) FILTER (g_error IS NOT NULL OR a_error IS NOT NULL) AS n_errors,
  round(avg(g) FILTER (has_fb AND confidence = 'high') - avg(a) FILTER (has_fb AND confidence = 'high'), 6) AS high_confidence_delta FROM j {group}"""


@query("coverage_lift", ARMS + _lift_sql("GROUP BY property", "property") + " UNION ALL " + _lift_sql("", "'(all)'"))
def q_coverage_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ex.coverage_lift(results(spark, sf_dir), feedback(spark, sf_dir))
    doubles = ["guided_coverage", "ablation_coverage", "coverage_delta", "guided_coverage_ok", "ablation_coverage_ok", "high_confidence_delta"]
    keep = ["n", "guided_success", "ablation_success", "guided_wins", "ablation_wins", "ties", "n_errors"]
    return m.select(F.when(F.col("overall") == 1, "(all)").otherwise(F.col("property")).alias("property"), *keep, *[r6(c) for c in doubles])


@query("error_records", ARMS + "SELECT instance_id, substr(coalesce(g_error, a_error), 1, 120) AS error FROM res WHERE coalesce(g_error, a_error) IS NOT NULL")
def q_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.error_records(results(spark, sf_dir))


@query("out_of_scope", "SELECT o_orderkey AS instance_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def q_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("instance_id"))
    return ex.out_of_scope(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id")), known)


PAIRS = """WITH g AS (SELECT o_orderkey AS instance_id, o_orderstatus = 'O' AS resolved, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS ptp_fail,
  o_totalprice > 250000 AS fired FROM orders WHERE o_orderpriority <> '1-URGENT'),
a AS (SELECT o_orderkey AS instance_id, o_totalprice < 150000 AS resolved, CASE WHEN o_totalprice > 300000 THEN 2 ELSE 0 END AS ptp_fail, FALSE AS fired
  FROM orders WHERE o_orderstatus <> 'P'),
audit AS (SELECT o_orderkey AS instance_id, o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS ana FROM orders WHERE o_orderstatus <> 'F'),
p AS (SELECT coalesce(g.instance_id, a.instance_id) AS instance_id, g.instance_id IS NOT NULL AS has_g, a.instance_id IS NOT NULL AS has_a,
  g.resolved AS g_res, a.resolved AS a_res, g.fired AS fired, a.ptp_fail AS broke FROM g FULL OUTER JOIN a ON g.instance_id = a.instance_id),
s AS (SELECT p.*, 'all' AS stratum FROM p UNION ALL
  SELECT p.*, CASE WHEN ana THEN 'analyzable' ELSE 'non_analyzable' END FROM p JOIN audit USING (instance_id)),
m AS (SELECT stratum, count(*) AS n, count(*) FILTER (has_g AND has_a) AS n_paired, count(*) FILTER (has_g AND has_a AND g_res) AS guided_resolved,
  count(*) FILTER (has_g AND has_a AND a_res) AS ablation_resolved, count(*) FILTER (has_g AND has_a AND broke > 0) AS broke,
  count(*) FILTER (has_g AND has_a AND broke > 0 AND fired) AS caught, count(*) FILTER (has_g AND has_a AND g_res AND fired) AS fired_on_correct FROM s GROUP BY stratum)
"""
_PM = """SELECT *, round(guided_resolved / CAST(n_paired AS DOUBLE), 6) AS guided_rate, round(ablation_resolved / CAST(n_paired AS DOUBLE), 6) AS ablation_rate,
  round((guided_resolved - ablation_resolved) / CAST(n_paired AS DOUBLE), 6) AS delta, round(caught / CAST(nullif(broke, 0) AS DOUBLE), 6) AS catch_rate,
  round(fired_on_correct / CAST(nullif(guided_resolved, 0) AS DOUBLE), 6) AS fp_rate FROM m"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").alias("instance_id")
    g = o.where("o_orderpriority <> '1-URGENT'").select(
        key, (F.col("o_orderstatus") == "O").alias("resolved"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("ptp_fail"),
        (F.col("o_totalprice") > 250000).alias("fired"))
    a = o.where("o_orderstatus <> 'P'").select(
        key, (F.col("o_totalprice") < 150000).alias("resolved"), F.when(F.col("o_totalprice") > 300000, 2).otherwise(0).alias("ptp_fail"),
        F.lit(False).alias("fired"))
    return ex.pair_arms(g, a)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "yes").otherwise("no")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("instance_id"), v.alias("would_catch"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ex.paired_metrics(pairs(spark, sf_dir), audit(spark, sf_dir))
    for c in ("guided_rate", "ablation_rate", "delta", "catch_rate", "fp_rate"):
        m = m.withColumn(c, r6(c))
    return m


@query("paired_arm_metrics", PAIRS + _PM)
def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query("headline_gate", PAIRS + f"SELECT delta, fp_rate, n_paired, delta > 0 AND (fp_rate IS NULL OR fp_rate < 0.10) AND n_paired >= 50 AS passed FROM ({_PM}) WHERE stratum = 'all'")
def q_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.headline_gate(_metrics(spark, sf_dir))


@query("unpaired_instances", PAIRS + "SELECT instance_id, CASE WHEN has_g THEN 'guided' ELSE 'ablation' END AS only FROM p WHERE NOT (has_g AND has_a)")
def q_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.unpaired(pairs(spark, sf_dir))


@query("preflight_estimate", """SELECT count(*) AS n, round(count(*) * 2 * 0.80, 6) AS cost, round(count(*) * 2 * 3.0, 6) AS cost_cap,
  round(count(*) * 2 * 720.0 / 8, 6)::DOUBLE AS wall_s, round(count(*) * 2 * 1800.0 / 8, 6)::DOUBLE AS wall_cap_s FROM orders""".replace("0.80, 6)", "0.80::DOUBLE, 6)").replace("3.0, 6)", "3.0::DOUBLE, 6)"))
def q_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ex.preflight(table(spark, sf_dir, "orders"), workers=8)
    return e.select("n", *[r6(c) for c in e.columns if c != "n"])


# -- sweeps and gates over parts and suppliers ---------------------------------------------------

SWEEP = """WITH sw AS (SELECT p_partkey AS instance_id, p_type <> 'PROMO' AS fetched, p_type <> 'PROMO' AND p_size > 40 AS fired,
  CASE WHEN p_type = 'PROMO' THEN 'fetch failed' ELSE '' END AS error,
  CASE WHEN p_type = 'PROMO' OR p_size <= 40 THEN 0 ELSE p_size % 3 END AS n_high, p_type <> 'PROMO' AND p_size > 45 AS medium FROM part)
"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, big = F.col("p_type") != "PROMO", F.col("p_size") > 40
    none = F.array().cast("array<string>")
    high = F.when(ok & big, F.array_repeat(F.lit("high"), (F.col("p_size") % 3).cast("int"))).otherwise(none)
    medium = F.when(ok & (F.col("p_size") > 45), F.array(F.lit("medium"))).otherwise(none)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instance_id"), ok.alias("fetched"), (ok & big).alias("fired"),
        F.when(ok, "").otherwise("fetch failed").alias("error"), F.concat(high, medium).alias("confidences"))


@query("fp_sweep", SWEEP + """SELECT *, CASE WHEN fp_rate < 0.05 THEN 'good' WHEN fp_rate < 0.15 THEN 'warn' WHEN fp_rate IS NOT NULL THEN 'bad' END AS band FROM (
SELECT count(*) AS n_total, count(*) FILTER (fetched) AS n_fetched, count(*) FILTER (fired) AS n_fired, count(*) FILTER (error <> '') AS n_errors,
  count(*) FILTER (n_high > 0) AS n_high, count(*) FILTER (medium) AS n_medium, round(count(*) FILTER (fired) / CAST(nullif(count(*) FILTER (fetched), 0) AS DOUBLE), 6) AS fp_rate FROM sw)""")
def q_fp_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.sweep_summary(sweep(spark, sf_dir)).withColumn("fp_rate", r6("fp_rate"))


@query("fp_sweep_top", SWEEP + "SELECT instance_id, n_high FROM sw WHERE fired ORDER BY n_high DESC, instance_id LIMIT 20")
def q_fp_sweep_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.sweep_top(sweep(spark, sf_dir))


GATE = """WITH e AS (SELECT l_orderkey AS c, l_returnflag AS symbol, l_linestatus AS kind, l_orderkey % 10 = 5 AS dedup FROM lineitem),
f AS (SELECT l_orderkey AS c, l_returnflag AS symbol, l_linestatus AS kind FROM lineitem WHERE l_discount < 0.08),
hit AS (SELECT DISTINCT c, symbol, kind FROM f), nf AS (SELECT c, count(*) AS n FROM f GROUP BY c),
x AS (SELECT e.c, count(*) AS expected, count(hit.c) AS matched, bool_or(dedup) AS dedup FROM e LEFT JOIN hit ON hit.c = e.c AND hit.symbol = e.symbol AND hit.kind = e.kind GROUP BY e.c),
m AS (SELECT x.c, expected, CASE WHEN dedup THEN least(coalesce(nf.n, 0), expected) ELSE matched END AS caught FROM x LEFT JOIN nf ON nf.c = x.c)
"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("kind"), "l_discount")
    expected = li.select("case", "symbol", "kind", (F.col("case") % 10 == 5).alias("dedup"))
    return ex.match_expected(expected, li.where("l_discount < 0.08").select("case", "symbol", "kind"))


@query("expected_matches", GATE + "SELECT c AS case_id, expected, caught FROM m")
def q_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select(F.col("case").alias("case_id"), "expected", "caught")


@query("corpus_gate", GATE + """, k AS (SELECT m.*, o_orderstatus <> 'P' AS fp_ok, caught AS witnesses, least(caught, 3) AS concrete, o_totalprice / 1000 AS latency_ms
  FROM m JOIN orders ON o_orderkey = m.c),
s AS (SELECT count(*) AS n_cases, CAST(sum(caught) AS BIGINT) AS caught, CAST(sum(expected) AS BIGINT) AS expected, count(*) FILTER (NOT fp_ok) AS fp_cases,
  CAST(sum(witnesses) AS BIGINT) AS witnesses, CAST(sum(concrete) AS BIGINT) AS concrete, round(avg(latency_ms) FILTER (latency_ms > 0), 6) AS avg_latency_ms FROM k)
SELECT *, round(caught / CAST(expected AS DOUBLE), 6) AS catch_rate, round(fp_cases / CAST(n_cases AS DOUBLE), 6) AS fp_rate, round(concrete / CAST(witnesses AS DOUBLE), 6) AS concrete_rate,
  caught / CAST(expected AS DOUBLE) >= 0.90 AND fp_cases = 0 AND concrete / CAST(witnesses AS DOUBLE) >= 0.70 AND avg_latency_ms < 2000 AS passed FROM s""")
def q_corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), (F.col("o_orderstatus") != "P").alias("fp_ok"),
                                              (F.col("o_totalprice") / 1000).alias("latency_ms"))
    k = matched(spark, sf_dir).join(o, "case").select("*", F.col("caught").alias("witnesses"), F.least("caught", F.lit(3)).alias("concrete"))
    g = ex.corpus_gate(k)
    for c in ("avg_latency_ms", "catch_rate", "fp_rate", "concrete_rate"):
        g = g.withColumn(c, r6(c))
    return g


@query("loop_summary", """WITH p AS (SELECT o_orderstatus <> 'F' AS g, o_totalprice < 200000 AS a, 1 + o_orderkey % 5 AS gi, 1 + o_custkey % 5 AS ai,
  o_totalprice / 100 AS t1, 10.0::DOUBLE AS t2 FROM orders)
SELECT count(*) AS n, count(*) FILTER (g) AS guided_fixed, count(*) FILTER (a) AS ablation_fixed, round(avg(gi) FILTER (g), 6) AS guided_iterations,
  round(avg(ai) FILTER (a), 6) AS ablation_iterations, round((sum(t1) + sum(t2)) / (2 * count(*)), 6) AS avg_latency_ms,
  round(count(*) FILTER (g) / CAST(count(*) AS DOUBLE), 6) AS guided_rate, round(count(*) FILTER (a) / CAST(count(*) AS DOUBLE), 6) AS ablation_rate,
  round((count(*) FILTER (g) - count(*) FILTER (a)) / CAST(count(*) AS DOUBLE), 6) AS delta,
  count(*) FILTER (g) / CAST(count(*) AS DOUBLE) >= 0.70 AND count(*) FILTER (g) > count(*) FILTER (a) AS passed FROM p""")
def q_loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") != "F").alias("g_success"), (F.col("o_totalprice") < 200000).alias("a_success"),
        (1 + F.col("o_orderkey") % 5).alias("g_iterations"), (1 + F.col("o_custkey") % 5).alias("a_iterations"),
        F.array(F.col("o_totalprice") / 100, F.lit(10.0)).alias("latency_ms"))
    s = ex.loop_summary(o)
    for c in ("guided_iterations", "ablation_iterations", "avg_latency_ms", "guided_rate", "ablation_rate", "delta"):
        s = s.withColumn(c, r6(c))
    return s


# -- patches from document lines -----------------------------------------------------------------

_MARK = "concat(CASE WHEN {z} % 10 = 0 THEN concat('@@ -', cast({z} * 7 % 400 + 1 AS {s}), ',', cast(length(x) % 9 + 1 AS {s}), ' +1,3 @@', chr(10)) ELSE '' END, CASE WHEN {z} % 2 = 0 THEN '-' ELSE '+' END, x)"
_HEAD = "concat('--- a/src/', source, '.py', chr(10), '+++ ', CASE WHEN n_chars % 5 = 0 THEN '/dev/null' ELSE concat('b/src/', source, '.py') END, chr(10))"
DOC = f"""WITH dl AS (SELECT doc_id, source, n_chars, text, string_split(text, chr(10)) AS ls FROM documents),
pt AS (SELECT doc_id, source, n_chars, text, concat({_HEAD}, array_to_string(list_transform(ls, lambda x, i: {_MARK.format(z='(i - 1)', s='varchar')}), chr(10))) AS patch,
  array_to_string(list_transform(list_filter(list_zip(ls, range(len(ls))), lambda p: p[2] % 3 <> 0), lambda p: p[1]), chr(10)) AS output FROM dl),
pl AS (SELECT doc_id, patch, output, regexp_split_to_array(patch, '\\r\\n|\\n|\\r') AS pls FROM pt)
"""


def doc_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = "split(text, '\\n')"
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.expr(f"concat({_HEAD}, array_join(transform({ls}, (x, i) -> {_MARK.format(z='i', s='string')}), chr(10)))").alias("patch"),
        F.expr(f"array_join(filter({ls}, (x, i) -> i % 3 <> 0), chr(10))").alias("output"))


@query("diff_files", DOC + """SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END AS n_files, CASE WHEN n_chars % 5 = 0 THEN '' ELSE concat('src/', source, '.py') END AS files FROM pt""")
def q_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = patches.modified_files("patch")
    return doc_patches(spark, sf_dir).select("doc_id", F.size(f).alias("n_files"), F.array_join(f, ",").alias("files"))


_SIG = """list_filter(list_transform(list_filter(pls, lambda x: starts_with(x, '{m}') AND NOT starts_with(x, '{m}{m}{m}')),
  lambda x: regexp_replace(substr(x, 2), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 8 AND NOT starts_with(x, '#')
  AND x NOT IN ('pass', 'return', 'else:', 'try:', 'finally:', 'continue', 'break'))"""


@query("significant_lines", DOC + f"SELECT doc_id, len({_SIG.format(m='+')}) AS n_added, len({_SIG.format(m='-')}) AS n_removed FROM pl")
def q_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_patches(spark, sf_dir).select(
        "doc_id", F.size(patches.significant_lines("patch", "+")).alias("n_added"), F.size(patches.significant_lines("patch", "-")).alias("n_removed"))


@query("patch_coverage", DOC + f""", sg AS (SELECT doc_id, output, {_SIG.format(m='+')} AS a, {_SIG.format(m='-')} AS r FROM pl)
SELECT doc_id, round(coalesce((len(list_filter(a, lambda x: contains(output, x))) + len(list_filter(r, lambda x: NOT contains(output, x))))
  / CAST(nullif(len(a) + len(r), 0) AS DOUBLE), 0), 6) AS coverage FROM sg""")
def q_patch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_patches(spark, sf_dir).select("doc_id", F.round(patches.patch_coverage("patch", "output"), 6).alias("coverage"))


_N_LINES = "CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n|\\r)\\z', ''), '\\r\\n|\\n|\\r')) END"
_HUNKS = """, hk AS (SELECT doc_id, unnest(list_filter(pls, lambda x: regexp_matches(x, '^@@ -\\d+(,\\d+)? '))) AS h FROM pl),
hr AS (SELECT doc_id, CAST(regexp_extract(h, '^@@ -(\\d+)', 1) AS INTEGER) AS s, CAST(regexp_extract(h, '^@@ -(\\d+)', 1) AS INTEGER)
  + CAST(regexp_extract(h, '^@@ -\\d+,(\\d+)', 1) AS INTEGER) - 1 AS e FROM hk)"""


@query("hunk_ranges", DOC + _HUNKS + " SELECT doc_id, s AS first_line, e AS last_line FROM hr")
def q_hunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_patches(spark, sf_dir).select("doc_id", F.explode(patches.hunk_ranges("patch")).alias("h")).select(
        "doc_id", F.col("h.s").alias("first_line"), F.col("h.e").alias("last_line"))


@query("hunk_merge", DOC + _HUNKS + """, pd AS (SELECT doc_id, greatest(1, s - 40) AS s, least(n, e + 40) AS e FROM hr JOIN (SELECT doc_id, """ + _N_LINES + """ AS n FROM dl) USING (doc_id)),
mx AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM pd),
gp AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mx)
SELECT doc_id, min(s) AS first_line, max(e) AS last_line FROM gp GROUP BY doc_id, g""")
def q_hunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The number of lines is bound once; inside the lambda over hunks the text would be split for each of them.
    m = f"transform(array(size({patches.lines('text')})), n -> {patches.merged_sql(patches.hunks_sql('patch'), 'n', '40')})[0]"
    return doc_patches(spark, sf_dir).select("doc_id", F.explode(F.expr(m)).alias("h")).select(
        "doc_id", F.col("h.s").alias("first_line"), F.col("h.e").alias("last_line"))


_SHOWN = 20
_CUT = """, ln AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n|\\r)\\z', ''), '\\r\\n|\\n|\\r') END AS l FROM dl),
bs AS (SELECT doc_id, text, l, len(l) AS n, coalesce(hs, 0) AS hs FROM ln LEFT JOIN (SELECT doc_id, count(*) AS hs FROM hr GROUP BY doc_id) USING (doc_id)),
cd AS (SELECT doc_id, n, k, greatest(1, greatest(5, CAST(floor({m} / (2 * greatest(1, hs))) AS INTEGER)) // CAST(2 ** k AS INTEGER)) AS c FROM bs, range(0, 6) r(k) WHERE n > {m} AND hs > 0),
pd AS (SELECT doc_id, k, c, n, greatest(1, s - c) AS s, least(n, e + c) AS e FROM cd JOIN hr USING (doc_id)),
mx AS (SELECT *, max(e) OVER (PARTITION BY doc_id, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM pd),
gp AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mx),
mg AS (SELECT doc_id, k, c, n, g, min(s) AS s, max(e) AS e FROM gp GROUP BY doc_id, k, c, n, g),
pk AS (SELECT doc_id, min(k) AS k FROM (SELECT doc_id, k, c, sum(e - s + 1) AS t FROM mg GROUP BY doc_id, k, c) WHERE t <= {m} OR c = 1 GROUP BY doc_id),
pc AS (SELECT mg.*, l, lag(mg.e, 1, 0) OVER (PARTITION BY doc_id ORDER BY g) AS prev FROM mg JOIN pk USING (doc_id, k) JOIN bs USING (doc_id)),
sh AS (SELECT doc_id, concat(string_agg(concat(CASE WHEN s > prev + 1 THEN concat('# ... (lines ', prev + 1, '–', s - 1, ' omitted) ...', chr(10)) ELSE '' END,
    array_to_string(CASE WHEN e < s THEN [] ELSE l[s:e] END, chr(10))), chr(10) ORDER BY g),
    CASE WHEN max_by(e, g) < any_value(n) THEN concat(chr(10), '# ... (lines ', max_by(e, g) + 1, '–', any_value(n), ' omitted) ...') ELSE '' END) AS shown FROM pc GROUP BY doc_id)
SELECT doc_id, CASE WHEN n <= {m} THEN text WHEN hs = 0 THEN array_to_string(l[1:{m}], chr(10)) ELSE shown END AS shown FROM bs LEFT JOIN sh USING (doc_id)"""


@query("relevant_truncation", DOC + _HUNKS + _CUT.replace("{m}", str(_SHOWN)))
def q_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to the surroundings of their hunks, the context halved until they fit."""
    t = patches.truncate_to_relevant("text", "patch", _SHOWN)
    return doc_patches(spark, sf_dir).select("doc_id", t.alias("shown"))


@query("code_blocks", """SELECT conv_id, turn, nullif(regexp_extract(t, '(?s)```(?:python)?\\n(.*?)```', 1), '') AS block FROM (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN concat('Answer:', chr(10), '```python', chr(10), text, '```', chr(10), '```', chr(10), 'x```') ELSE text END AS t FROM conversations)""")
def q_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fenced block of each turn; assistant turns are put into a fence."""
    fence = F.concat(F.lit("Answer:\n```python\n"), "text", F.lit("```\n```\nx```"))
    c = table(spark, sf_dir, "conversations").withColumn("t", F.when(F.col("role") == "assistant", fence).otherwise(F.col("text")))
    return c.select("conv_id", "turn", patches.code_block("t").alias("block"))


_ANN = "CASE p_size % 12 WHEN 0 THEN concat('Optional[', t, ']') WHEN 1 THEN concat('Union[', t, ', None]') WHEN 2 THEN concat(t, ' | None') WHEN 3 THEN concat('List[', t, ']') WHEN 4 THEN 'str' WHEN 5 THEN 'NoneCheck' WHEN 6 THEN concat('typing.Optional[', t, ']') WHEN 7 THEN concat('Dict[', t, ', None]') WHEN 8 THEN concat('Union[', t, ', NoneCheck]') WHEN 9 THEN concat('list[', t, ']') WHEN 10 THEN ' None ' ELSE t END"


@query("annotation_nullability", f"""SELECT p_partkey, CASE WHEN p_size % 12 IN (0, 1, 2, 6, 10) THEN 'Nullable' WHEN p_size % 12 IN (3, 4) THEN 'NonNull' ELSE 'Unknown' END AS nullability FROM part""")
def q_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").withColumn("t", F.regexp_replace("p_type", "[^A-Za-z]", "")).withColumn("ann", F.expr(_ANN))
    return a.select("p_partkey", annotation_nullability("ann").alias("nullability"))


@query("latest_upsert", """SELECT 'ws' AS ws, url AS uri, max_by(html, page_id) AS text, max(page_id) AS rev FROM pages GROUP BY url""")
def q_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as file versions, the even ones registered before, the odd ones as edits: the highest page id of a url wins."""
    p = table(spark, sf_dir, "pages").select(F.lit("ws").alias("ws"), F.col("url").alias("uri"), F.col("html").alias("text"), F.col("page_id").alias("rev"))
    old = F.col("rev") % 2 == 0
    return upsert_files(upsert_files(p.where(old).limit(0), p.where(old)), p.where(~old))


@query("content_hashes", "SELECT page_id, md5(html) AS sha, regexp_replace(url, '[/\\\\]', '__', 'g') AS safe FROM pages")
def q_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", content_hash("html").alias("sha"), patches.safe_name("url").alias("safe"))


@query("symbol_lines", """SELECT item_id, CASE WHEN p > 0 THEN strlen(substr(text, 1, p - 1)) END AS position,
  CASE WHEN p > 0 THEN 1 + length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) END AS line
FROM (SELECT item_id, text, CASE WHEN regexp_matches(text, '\\bthe\\b') THEN length(regexp_extract(text, '(?s)^(.*?)\\bthe\\b', 1)) + 1 ELSE 0 END AS p FROM benchmark)""")
def q_symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First whole-word occurrence of a name as byte position and line."""
    b = table(spark, sf_dir, "benchmark").withColumn("symbol", F.lit("the"))
    b = b.withColumn("position", patches.symbol_position("text", "symbol"))
    return b.select("item_id", "position", F.when(F.col("position").isNotNull(), patches.byte_to_line("text", "position")).alias("line"))
