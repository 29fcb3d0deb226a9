"""Aggregates over experiment records: audit buckets, coverage lift, paired arms, sweeps and gates.

Everything is a conditional aggregate with map-side combine; rates that are undefined stay null here
and become NaN only in reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of labelled records.
CATEGORIES = ["null_type", "incomplete_edit", "wrong_logic", "missing_edge", "integration", "api_misuse",
              "misunderstood_intent", "other", "unlabeled"]
VERDICTS = ["yes", "partial", "no", "unknown"]
PROPERTIES = ["nullability", "change_consistency", "type_safety", "resource_lifetime", "other", "none"]
SOURCES = ["gold", "agent_failed", "agent_partial", "agent_regressed"]

# Thresholds of signals and gates.
KILL_FRACTION = 0.40
WIN_MARGIN = 0.05
FP_GATE, MIN_PAIRS = 0.10, 50
CATCH_GATE, CONCRETE_GATE, LATENCY_GATE_MS = 0.90, 0.70, 2000.0
FIX_GATE = 0.70
# Planning constants per arm and instance (cost, seconds).
COST, COST_CAP, SECONDS, SECONDS_CAP = 0.80, 3.00, 720.0, 1800.0
# Fixed value: note put before an overridden property.
PROPERTY_NOTE = "[auto: which_property set to 'other' — model returned 'none' for a yes/partial verdict] "


def is_labeled() -> Column:
    return F.col("category") != "unlabeled"


def is_analyzable() -> Column:
    return F.col("would_catch").isin("yes", "partial")


def count_if(c: Column) -> Column:
    return F.count_if(c)


def rate(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d)


def rate_or_zero(n: Column, d: Column) -> Column:
    return F.coalesce(rate(n, d), F.lit(0.0))


def parse_choice(column: str, choices: list[str], what: str) -> Column:
    """Lower-cased choice; anything outside the vocabulary raises."""
    c = F.lower(F.col(column))
    return F.when(c.isin(*choices), c).otherwise(F.raise_error(F.concat(F.lit(f"Unknown {what}: "), F.col(column))))


def filter_failures(df: DataFrame, labeled_only=False, analyzable_only=False, category=None, verdict=None, source=None) -> DataFrame:
    """All given conditions together; they reach the scan as pushed filters."""
    if labeled_only:
        df = df.where(is_labeled())
    if analyzable_only:
        df = df.where(is_analyzable())
    for col, want in (("category", category), ("would_catch", verdict), ("patch_source", source)):
        if want is not None:
            df = df.where(F.col(col) == want)
    return df


def audit_ids(audit: DataFrame, verdict: str) -> DataFrame:
    """Each instance once whose verdict is ``analyzable`` (yes or partial), ``non_analyzable`` (no) or ``any`` (not empty)."""
    is_no = F.col("would_catch") == "no"
    wanted = {"analyzable": is_analyzable(), "non_analyzable": is_no, "any": F.col("would_catch") != ""}
    return audit.where(wanted[verdict]).select("instance_id").distinct()


def failed_held_out() -> Column:
    """Held-out tests that did not pass, including those without a result."""
    return F.expr("filter(fail_to_pass, t -> NOT (test_results[t] <=> 'PASSED'))")


def broke_passing() -> Column:
    """Formerly passing tests that now fail."""
    return F.expr("filter(pass_to_pass, t -> test_results[t] <=> 'FAILED')")


def apply_label(confidence: str = "labeler_confidence") -> list[Column]:
    """Validated label columns: an analysable verdict without a property gets ``other`` and a note,
    and anything but high confidence is tagged in the note."""
    repair = F.col("would_catch").isin("yes", "partial") & (F.col("which_property") == "none")
    note = F.coalesce("analysis_note", F.lit(""))
    note = F.when(repair, F.concat(F.lit(PROPERTY_NOTE), note)).otherwise(note)
    sure = F.coalesce(F.col(confidence), F.lit("unknown"))
    return [parse_choice("category", CATEGORIES, "category").alias("category"),
            parse_choice("would_catch", VERDICTS, "verdict").alias("would_catch"),
            F.when(repair, "other").otherwise(F.col("which_property")).alias("which_property"),
            F.when(sure != "high", F.concat(F.lit("[confidence:"), sure, F.lit("] "), note)).otherwise(note).alias("analysis_note")]


def confidence_tag(note: str = "analysis_note") -> Column:
    """Confidence read back from a tagged note; untagged notes are high."""
    return F.when(F.col(note).contains("[confidence:"), F.regexp_extract(note, r"\[confidence:([^\]]*)\]", 1)).otherwise("high")


def property_confidence(prop: str) -> Column:
    """How far feedback about a property is trusted."""
    return F.when(F.col(prop) == "nullability", "high").when(F.col(prop) == "change_consistency", "medium").otherwise("low")


def audit_buckets(failures: DataFrame) -> DataFrame:
    verdict = lambda v: count_if(F.col("would_catch") == v)
    b = failures.where(is_labeled()).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), *[verdict(v).alias(v) for v in VERDICTS])
    return b.select("category", "n", (F.col("yes") + F.col("partial")).alias("analyzable"), *VERDICTS,
                    rate_or_zero(F.col("yes") + F.col("partial"), F.col("n")).alias("analyzable_rate")).orderBy(F.desc("n"), "category")


def property_votes(failures: DataFrame) -> DataFrame:
    return (failures.where(is_labeled() & is_analyzable() & (F.col("which_property") != "none"))
            .groupBy("which_property").agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), "which_property"))


def audit_signals(failures: DataFrame) -> DataFrame:
    """One row of headline fractions and signals; the vote winner ties by vocabulary order."""
    lab, ana = is_labeled(), is_labeled() & is_analyzable()
    voted = [p for p in PROPERTIES if p != "none"]
    a = failures.agg(
        F.count(F.lit(1)).alias("n_total"), count_if(lab).alias("n_labeled"), count_if(ana).alias("n_analyzable"),
        count_if(F.col("category") == "misunderstood_intent").alias("mis"),
        *[count_if(ana & (F.col("which_property") == p)).alias(f"v_{p}") for p in voted])
    best = F.greatest(*[F.struct(F.col(f"v_{p}").alias("n"), F.lit(-i).alias("o"), F.lit(p).alias("p")) for i, p in enumerate(voted)])
    mis = rate_or_zero(F.col("mis"), F.col("n_labeled"))
    return a.select(
        "n_total", "n_labeled", "n_analyzable", rate_or_zero(F.col("n_analyzable"), F.col("n_labeled")).alias("analyzable_rate"),
        F.when(best["n"] > 0, best["p"]).otherwise("none").alias("recommended_property"),
        mis.alias("misunderstood_fraction"), (mis > KILL_FRACTION).alias("kill_signal"),
        rate_or_zero(F.col("v_change_consistency"), F.col("n_analyzable")).alias("change_consistency_fraction"),
        (F.col("v_change_consistency") > F.col("v_nullability")).alias("redirect_signal"))


def score(success: str, stored: str, recomputed: str | None = None) -> Column:
    """Coverage of one arm: 0 without success, a recomputed score before the stored one."""
    best = F.col(stored) if recomputed is None else F.coalesce(F.col(recomputed), F.col(stored))
    return F.when(F.col(success), F.coalesce(best, F.lit(0.0))).otherwise(F.lit(0.0))


def coverage_lift(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Coverage metrics over all results and per property in one pass (grouping sets).

    ``results``: instance_id, success/cov/error per arm (``g_`` guided, ``a_`` ablation).
    ``feedback``: instance_id, which_property, confidence; missing metadata is stratum ``unknown``.
    """
    d = results.join(feedback.select("instance_id", "which_property", "confidence"), "instance_id", "left")
    d = d.select(
        F.coalesce("which_property", F.lit("unknown")).alias("property"), "confidence", "g_success", "a_success", "g_error", "a_error",
        score("g_success", "g_cov").alias("g"), score("a_success", "a_cov").alias("a"), "g_cov", "a_cov")
    gap = F.col("g") - F.col("a")
    high = F.col("confidence") == "high"
    out = d.groupingSets([["property"], []], "property").agg(
        F.grouping("property").alias("overall"), F.count(F.lit(1)).alias("n"),
        F.avg("g").alias("guided_coverage"), F.avg("a").alias("ablation_coverage"),
        F.avg(F.when(F.col("g_success"), F.col("g_cov"))).alias("guided_coverage_ok"),
        F.avg(F.when(F.col("a_success"), F.col("a_cov"))).alias("ablation_coverage_ok"),
        count_if(F.col("g_success")).alias("guided_success"), count_if(F.col("a_success")).alias("ablation_success"),
        count_if(gap > WIN_MARGIN).alias("guided_wins"), count_if(gap < -WIN_MARGIN).alias("ablation_wins"),
        (F.avg(F.when(high, F.col("g"))) - F.avg(F.when(high, F.col("a")))).alias("high_confidence_delta"),
        count_if((F.coalesce("g_error", F.lit("")) != "") | (F.coalesce("a_error", F.lit("")) != "")).alias("n_errors"))
    return out.withColumn("coverage_delta", F.col("guided_coverage") - F.col("ablation_coverage")).withColumn(
        "ties", F.col("n") - F.col("guided_wins") - F.col("ablation_wins"))


def error_records(results: DataFrame) -> DataFrame:
    """Instances with an error and its first 120 characters, the guided arm's first."""
    e = F.coalesce(F.nullif("g_error", F.lit("")), F.nullif("a_error", F.lit("")))
    return results.withColumn("e", e).where("e IS NOT NULL").select("instance_id", F.substring("e", 1, 120).alias("error"))


def diagnostics(results: DataFrame) -> DataFrame:
    """How many records there are, have an error in either arm, or come from before scores were kept."""
    error = F.coalesce(F.nullif("g_error", F.lit("")), F.nullif("a_error", F.lit("")))
    return results.agg(F.count(F.lit(1)).alias("n"), count_if(error.isNotNull()).alias("n_errors"), count_if(F.col("legacy")).alias("n_legacy"))


def out_of_scope(results: DataFrame, analyzable: DataFrame) -> DataFrame:
    """Results outside the analysable set; nothing when that set is empty."""
    known = analyzable.agg(F.count(F.lit(1)) > 0).scalar()
    return results.join(analyzable.select("instance_id").distinct(), "instance_id", "left_anti").where(known).select("instance_id")


def pair_arms(guided: DataFrame, ablation: DataFrame) -> DataFrame:
    """Two arms side by side; an instance with one arm keeps nulls on the other."""
    pack = lambda df, p: df.select("instance_id", F.struct("resolved", "ptp_fail", "fired").alias(p))
    return pack(guided, "g").join(pack(ablation, "a"), "instance_id", "full_outer")


def paired_metrics(pairs: DataFrame, audit: DataFrame) -> DataFrame:
    """Paired metrics for all instances and, for audited ones, by analysability.

    A row is copied into its strata (at most two) before one grouped aggregate.
    """
    d = pairs.join(audit.select("instance_id", is_analyzable().alias("ana")), "instance_id", "left")
    strata = F.expr("filter(array('all', CASE WHEN ana THEN 'analyzable' WHEN NOT ana THEN 'non_analyzable' END), x -> x IS NOT NULL)")
    paired = F.col("g").isNotNull() & F.col("a").isNotNull()
    g, broke = paired & F.col("g.resolved"), paired & (F.col("a.ptp_fail") > 0)
    m = d.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), count_if(paired).alias("n_paired"),
        count_if(g).alias("guided_resolved"), count_if(paired & F.col("a.resolved")).alias("ablation_resolved"),
        count_if(broke).alias("broke"), count_if(broke & F.col("g.fired")).alias("caught"),
        count_if(g & F.col("g.fired")).alias("fired_on_correct"))
    r = lambda n, d: rate(F.col(n), F.col(d))
    return m.select(
        "*", F.coalesce(r("guided_resolved", "n_paired"), F.lit(0.0)).alias("guided_rate"),
        F.coalesce(r("ablation_resolved", "n_paired"), F.lit(0.0)).alias("ablation_rate"),
        F.coalesce(rate(F.col("guided_resolved") - F.col("ablation_resolved"), F.col("n_paired")), F.lit(0.0)).alias("delta"),
        r("caught", "broke").alias("catch_rate"), r("fired_on_correct", "guided_resolved").alias("fp_rate"))


def headline_gate(metrics: DataFrame) -> DataFrame:
    """Pass when the delta is positive, false positives are rare or undefined, and enough pairs exist."""
    return metrics.where("stratum = 'all'").select(
        "delta", "fp_rate", "n_paired",
        ((F.col("delta") > 0) & (F.col("fp_rate").isNull() | (F.col("fp_rate") < FP_GATE)) & (F.col("n_paired") >= MIN_PAIRS)).alias("passed"))


def unpaired(pairs: DataFrame) -> DataFrame:
    """Instances with a single arm."""
    return pairs.where("g IS NULL OR a IS NULL").select("instance_id", F.when(F.col("a").isNull(), "guided").otherwise("ablation").alias("only"))


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """False-positive sweep: rows with fetched, fired, error, confidences."""
    s = sweep.agg(
        F.count(F.lit(1)).alias("n_total"), count_if(F.col("fetched")).alias("n_fetched"), count_if(F.col("fired")).alias("n_fired"),
        count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"),
        count_if(F.array_contains("confidences", "high")).alias("n_high"), count_if(F.array_contains("confidences", "medium")).alias("n_medium"))
    fp = rate(F.col("n_fired"), F.col("n_fetched"))
    band = F.when(fp < 0.05, "good").when(fp < 0.15, "warn").when(fp.isNotNull(), "bad")
    return s.select("*", fp.alias("fp_rate"), band.alias("band"))


def sweep_top(sweep: DataFrame, n: int = 20) -> DataFrame:
    """The fired instances with most high-confidence findings."""
    high = F.size(F.filter("confidences", lambda c: c == "high"))
    return sweep.where("fired").select("instance_id", high.alias("n_high")).orderBy(F.desc("n_high"), "instance_id").limit(n)


def match_expected(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per case, how many expected regressions are found.

    ``expected``: case, symbol, kind, dedup; ``found``: case, symbol, kind (one row per consumer). An
    expectation counts when any consumer has its symbol and kind; in dedup cases consumers are counted.
    """
    key, one, none = ["case", "symbol", "kind"], F.lit(1), F.lit(0)
    both = expected.select(*key, "dedup", one.alias("e"), none.alias("f")).unionByName(
        found.select(*key, F.lit(None).cast("boolean").alias("dedup"), none.alias("e"), one.alias("f")))
    # Both sides are counted in the same groups, so nothing is sorted or joined; null equals nothing.
    per = both.groupBy(*key).agg(F.sum("e").alias("e"), F.sum("f").alias("f"), F.bool_or("dedup").alias("dedup"))
    hit = (F.col("f") > 0) & F.col("case").isNotNull() & F.col("symbol").isNotNull() & F.col("kind").isNotNull()
    cases = per.groupBy("case").agg(
        F.sum("e").alias("expected"), F.sum(F.when(hit, F.col("e")).otherwise(0)).alias("matched"),
        F.sum(F.when(F.col("case").isNotNull(), F.col("f")).otherwise(0)).alias("n_found"), F.bool_or("dedup").alias("dedup"))
    return cases.where("expected > 0").select("case", "expected", F.when(
        F.col("dedup"), F.least("n_found", "expected")).otherwise(F.col("matched")).alias("caught"))


def corpus_gate(cases: DataFrame) -> DataFrame:
    """Corpus summary: expected, caught, fp_ok, witnesses, concrete, latency_ms per case.

    Without a measured latency the gate is null, unless another condition fails it.
    """
    s = cases.agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("caught").alias("caught"), F.sum("expected").alias("expected"),
        count_if(~F.col("fp_ok")).alias("fp_cases"), F.sum("witnesses").alias("witnesses"), F.sum("concrete").alias("concrete"),
        F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("avg_latency_ms"))
    one = F.lit(1.0)
    s = s.select("*", F.coalesce(rate(F.col("caught"), F.col("expected")), one).alias("catch_rate"),
                 rate_or_zero(F.col("fp_cases"), F.col("n_cases")).alias("fp_rate"),
                 F.coalesce(rate(F.col("concrete"), F.col("witnesses")), one).alias("concrete_rate"))
    return s.select("*", ((F.col("catch_rate") >= CATCH_GATE) & (F.col("fp_rate") <= 0) & (F.col("concrete_rate") >= CONCRETE_GATE)
                          & (F.col("avg_latency_ms") < LATENCY_GATE_MS)).alias("passed"))


def loop_summary(pairs: DataFrame) -> DataFrame:
    """Edit-loop summary: success and iterations per arm, latencies of the guided arm.

    Latencies enter as (sum, count) per row, so the overall mean needs no exploded rows.
    """
    s = pairs.agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("g_success")).alias("guided_fixed"), count_if(F.col("a_success")).alias("ablation_fixed"),
        F.avg(F.when(F.col("g_success"), F.col("g_iterations"))).alias("guided_iterations"),
        F.avg(F.when(F.col("a_success"), F.col("a_iterations"))).alias("ablation_iterations"),
        F.sum(F.aggregate("latency_ms", F.lit(0.0), lambda a, x: a + x)).alias("t"), F.sum(F.size("latency_ms")).alias("k"))
    g, a = rate_or_zero(F.col("guided_fixed"), F.col("n")), rate_or_zero(F.col("ablation_fixed"), F.col("n"))
    return s.select("n", "guided_fixed", "ablation_fixed", "guided_iterations", "ablation_iterations",
                    rate_or_zero(F.col("t"), F.col("k")).alias("avg_latency_ms"), g.alias("guided_rate"), a.alias("ablation_rate"),
                    (g - a).alias("delta"), ((g >= FIX_GATE) & (g - a > 0)).alias("passed"))


def repo_counts(df: DataFrame, n: int = 20) -> DataFrame:
    return df.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo").limit(n)


def preflight(instances: DataFrame, workers: int, arms: int = 2) -> DataFrame:
    """Expected and worst-case cost and time of a run."""
    runs = F.col("n") * arms
    return instances.agg(F.count(F.lit(1)).alias("n")).select(
        "n", (runs * COST).alias("cost"), (runs * COST_CAP).alias("cost_cap"),
        (runs * SECONDS / max(workers, 1)).alias("wall_s"), (runs * SECONDS_CAP / max(workers, 1)).alias("wall_cap_s"))
