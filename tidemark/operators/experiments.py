"""Controlled experiments: integrity, exposure, outcomes, effects, guardrails and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import rate, unpivoted


def integrity(assignments: DataFrame, users: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Assignments with ``reasons`` why they can't count: unknown user, experiment or variant, exposure before assignment, more than one variant."""
    known = users.select("user_id").distinct().withColumn("_known", F.lit(True))
    arms = assignments.groupBy("experiment", "user_id").agg(F.countDistinct("variant").alias("_arms"))
    rows = assignments.join(known, "user_id", "left").join(arms, ["experiment", "user_id"])
    allowed = F.lit(False)
    for experiment, names in variants.items():
        allowed |= (F.col("experiment") == experiment) & F.col("variant").isin(names)
    tests = {"unknown_user": F.col("_known").isNull(), "unknown_experiment": ~F.col("experiment").isin(list(variants)), "unknown_variant": ~allowed, "exposed_before_assignment": F.col("exposure_ts") < F.col("assigned_ts"), "several_variants": F.col("_arms") > 1}
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))).drop("_known", "_arms")


def exposed(assignments: DataFrame, events: DataFrame, names: list[str], days: int) -> DataFrame:
    """Assignments whose missing exposure is the first such event within ``days`` of assignment, both ends included."""
    seen = events.where(F.col("event_name").isin(names)).select("user_id", "ts")
    until = (F.col("assigned_ts") + F.expr(f"INTERVAL {days} DAYS")).cast("timestamp_ntz")
    first = assignments.join(seen, "user_id").where(F.col("ts").between(F.col("assigned_ts"), until)).groupBy("experiment", "user_id").agg(F.min("ts").alias("_first"))
    return assignments.join(first, ["experiment", "user_id"], "left").withColumn("exposure_ts", F.coalesce("exposure_ts", "_first")).drop("_first")


def populations(rows: DataFrame) -> DataFrame:
    """Each assignment once as intention_to_treat, and as exposed if it was; basis_ts is when its outcomes start to count."""
    both = rows.withColumn("population", F.explode(F.when(F.col("exposure_ts").isNotNull(), F.array(F.lit("intention_to_treat"), F.lit("exposed"))).otherwise(F.array(F.lit("intention_to_treat")))))
    return both.withColumn("basis_ts", F.when(F.col("population") == "exposed", F.col("exposure_ts")).otherwise(F.col("assigned_ts")))


def outcomes(rows: DataFrame, events: DataFrame, metrics: dict[str, str], days: int) -> DataFrame:
    """One value per assignment and metric, from events in [basis, basis + days]; a metric is an aggregate over event_name, value and ts."""
    until = (F.col("basis_ts") + F.expr(f"INTERVAL {days} DAYS")).cast("timestamp_ntz")
    near = rows.join(events, "user_id", "left").where(F.col("ts").isNull() | F.col("ts").between(F.col("basis_ts"), until))
    keys = ["experiment", "population", "variant", "user_id"]
    got = near.groupBy(*keys).agg(*(F.expr(e).cast("double").alias(n) for n, e in metrics.items()))
    got = rows.select(*keys).join(got, keys, "left").na.fill(0.0, list(metrics))
    return got.unpivot(keys, list(metrics), "metric", "value")


def ratio_check(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Sample-ratio mismatch per experiment: chi-square of arm sizes against their shares."""
    total = rows.groupBy("experiment").agg(F.count("*").alias("n"), *(F.count_if(F.col("variant") == v).alias(f"n_{v}") for v in shares))
    terms = [F.pow(F.col(f"n_{v}") - F.col("n") * s, 2) / (F.col("n") * s) for v, s in shares.items()]
    return total.withColumn("statistic", F.bround(sum(terms), 6)).withColumn("degrees", F.lit(len(shares) - 1))


def arms(values: DataFrame, control: str) -> DataFrame:
    """Sizes, sums, means and sample variances of control and treatment side by side, per metric and treatment."""
    by = values.groupBy("experiment", "population", "metric", "variant").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.coalesce(F.nanvl(F.var_samp("value"), F.lit(0.0)), F.lit(0.0)).alias("variance"))
    left = by.where(F.col("variant") == control).select("experiment", "population", "metric", *(F.col(x).alias(f"c_{x}") for x in ("n", "total", "mean", "variance")))
    right = by.where(F.col("variant") != control).select("experiment", "population", "metric", F.col("variant").alias("treatment"), *(F.col(x).alias(f"t_{x}") for x in ("n", "total", "mean", "variance")))
    return left.join(right, ["experiment", "population", "metric"])


def effects(sides: DataFrame, binary: list[str]) -> DataFrame:
    """Effect, standard error and test statistic: two proportions for binary metrics, Welch's t for others; six places."""
    keys = ["experiment", "population", "metric", "treatment", F.col("c_n").alias("control_n"), F.col("t_n").alias("treatment_n")]
    names = ["control_value", "treatment_value", "absolute_effect", "relative_effect", "standard_error", "statistic", "degrees"]
    p = stats.proportion_columns("c_total", "c_n", "t_total", "t_n") | {"degrees": F.lit(0.0)}
    w = stats.welch_columns("c_mean", "c_variance", "c_n", "t_mean", "t_variance", "t_n")
    is_binary = F.col("metric").isin(binary)
    return sides.select(*keys, *(F.bround(F.when(is_binary, p[n]).otherwise(w[n]), 6).alias(n) for n in names))


def tested(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Effects with p value, interval and p adjusted within experiment and population."""
    z = stats.NORMAL.inv_cdf(1 - (1 - confidence) / 2)
    rows = rows.withColumn("p_value", F.bround(F.when(F.col("degrees") > 0, stats.t_p("statistic", "degrees")).otherwise(stats.normal_p("statistic")), 6))
    critical = F.when(F.col("degrees") > 0, stats.t_critical("degrees", F.lit(confidence))).otherwise(F.lit(z))
    rows = rows.withColumn("_c", critical).withColumn("low", F.bround(F.col("absolute_effect") - F.col("_c") * F.col("standard_error"), 6)).withColumn("high", F.bround(F.col("absolute_effect") + F.col("_c") * F.col("standard_error"), 6)).drop("_c")
    return stats.adjusted(rows, ["experiment", "population"])


def guardrails(rows: DataFrame, limits: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """Intention-to-treat guardrail metrics: harmed if the effect in the bad direction passes its limit; only critical ones fail."""
    out = F.lit(None).cast("string")
    harm = F.lit(False)
    for metric, (good, limit, critical) in limits.items():
        bad = (F.col("absolute_effect") if good == "decrease" else -F.col("absolute_effect")) > limit
        here = F.col("metric") == metric
        harm |= here & bad
        out = F.when(here, F.when(bad & F.lit(critical), "fail").otherwise("pass")).otherwise(out)
    kept = rows.where((F.col("population") == "intention_to_treat") & F.col("metric").isin(list(limits)))
    return kept.select("experiment", "treatment", "metric", "absolute_effect", harm.alias("harmed"), out.alias("status"))


def selected(assignments: DataFrame, variants: dict[str, list[str]], wanted: list[str] | None = None) -> DataFrame:
    """Assignments of the wanted experiments, all without a wish; an unknown one is an error."""
    if bad := sorted(set(wanted or []) - set(variants)):
        raise ValueError(f"unknown experiment {', '.join(bad)}")
    return assignments.where(F.col("experiment").isin(list(wanted or variants)))


def roles(rows: DataFrame, primary: str, guarded: list[str]) -> DataFrame:
    return rows.withColumn("role", F.when(F.col("metric") == primary, "primary").when(F.col("metric").isin(guarded), "guardrail").otherwise("secondary"))


def statuses(rows: DataFrame, directions: dict[str, tuple[str, float]], alpha: float = 0.05) -> DataFrame:
    """Tested effects with significance, practical (the effect passes its threshold in the good direction) and data quality."""
    sign, least = F.lit(1.0), F.lit(0.0)
    for metric, (good, threshold) in directions.items():
        here = F.col("metric") == metric
        sign = F.when(here, 1.0 if good == "increase" else -1.0).otherwise(sign)
        least = F.when(here, float(threshold)).otherwise(least)
    quality = F.when((F.col("control_n") == 0) | (F.col("treatment_n") == 0), "zero_denominator").when((F.col("control_n") < 2) | (F.col("treatment_n") < 2), "small_sample_warning").otherwise("ok")
    return rows.select("*", F.when(F.col("adjusted_p") < alpha, "significant").otherwise("not_significant").alias("significance"), F.when(sign * F.col("absolute_effect") >= least, "met").otherwise("not_met").alias("practical"), quality.alias("quality"))


def decisions(primary: DataFrame, guards: DataFrame, ratios: DataFrame, excluded: DataFrame, least_effect: float, needed: DataFrame, alpha: float = 0.05, max_ratio: float = 6.634897) -> DataFrame:
    """Ordered rules with reason codes for each treatment's primary metric, of which more is better.

    ``primary`` has adjusted_p, ``needed`` users_per_arm by experiment; an experiment with excluded assignments
    or a broken ratio is invalid.
    """
    failed = guards.groupBy("experiment", "treatment").agg(F.count_if(F.col("status") == "fail").alias("failed"))
    rows = primary.join(failed, ["experiment", "treatment"], "left").join(ratios.select("experiment", F.col("statistic").alias("ratio")), "experiment", "left")
    rows = rows.join(excluded.groupBy("experiment").agg(F.count("*").alias("excluded")), "experiment", "left").join(needed.select("experiment", "users_per_arm"), "experiment", "left")
    effect, sure, big = F.col("absolute_effect"), F.col("adjusted_p") < alpha, F.col("absolute_effect") >= least_effect
    enough = F.least("control_n", "treatment_n") >= F.coalesce("users_per_arm", F.lit(0))
    choices = [
        ((F.col("ratio") > max_ratio) | (F.coalesce("excluded", F.lit(0)) > 0), "invalid_experiment", "integrity_or_srm_blocker"), (F.coalesce("failed", F.lit(0)) > 0, "do_not_ship", "critical_guardrail_harm"),
        ((effect < -least_effect) & sure, "do_not_ship", "primary_metric_degradation"), ((effect > 0) & sure & big & enough, "ship", "statistical_and_practical_primary_lift"),
        ((effect > 0) & big & enough, "ship_with_caution", "practical_lift_without_full_statistical_confidence"), ((effect > 0) & big, "continue_experiment", "promising_underpowered_effect"),
    ]
    pick = lambda k, last: F.coalesce(*(F.when(c, F.lit((d, r)[k])) for c, d, r in choices), F.lit(last))
    return rows.select("experiment", "treatment", "absolute_effect", "adjusted_p", "ratio", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("excluded", F.lit(0)).alias("excluded"), pick(0, "no_clear_evidence").alias("decision"), F.array(pick(1, "primary_metric_not_statistically_or_practically_clear")).alias("reason_codes"))


def segment_effects(values: DataFrame, users: DataFrame, dimensions: list[str], metric: str, control: str, suppression: int) -> DataFrame:
    """The effect on a binary metric by one dimension at a time, of those assigned; hidden where either arm has fewer than ``suppression``."""
    rows = values.where((F.col("population") == "intention_to_treat") & (F.col("metric") == metric)).join(users.select("user_id", *dimensions), "user_id")
    rows = unpivoted(rows.select("experiment", "variant", "value", *dimensions).withColumnRenamed("value", "v"), ["experiment", "variant", "v"], dimensions)
    by = rows.groupBy("experiment", "dimension", "value", "variant").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    keys = ["experiment", "dimension", "value"]
    groups = by.select(*keys).distinct()
    left = by.where(F.col("variant") == control).select(*keys, F.col("n").alias("c_n"), F.col("total").alias("c_total"))
    treated = by.where(F.col("variant") != control).select(*keys, F.col("variant").alias("treatment"), F.col("n").alias("t_n"), F.col("total").alias("t_total"))
    rows = groups.join(left, keys, "left").join(treated, keys).na.fill(0, ["c_n", "t_n"]).na.fill(0.0, ["c_total", "t_total"])
    p = stats.proportion_columns("c_total", "c_n", "t_total", "t_n")
    hidden = F.least("c_n", "t_n") < suppression
    return rows.select(*keys, "treatment", F.col("c_n").alias("control_n"), F.col("t_n").alias("treatment_n"), *(F.when(~hidden, F.bround(p[x], 6)).alias(x) for x in ("absolute_effect", "statistic")), F.when(hidden, "suppressed").otherwise("shown").alias("status"))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def guardrail_summary(guards: DataFrame) -> DataFrame:
    """Per experiment and treatment: passed, or which guardrails failed."""
    names = F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("metric"))))
    return guards.groupBy("experiment", "treatment").agg(F.when(F.size(names) == 0, "passed").otherwise(F.concat(F.lit("failed "), F.array_join(names, ", "))).alias("guardrails"))


def diagnostics(judged: DataFrame, valid: DataFrame, rows: DataFrame, ratios: DataFrame, segments: DataFrame, guards: DataFrame, decided: DataFrame, max_ratio: float = 6.634897) -> DataFrame:
    """One row of findings over all experiments, and passed, passed_with_warnings or failed."""
    parts = [
        judged.agg(F.count("*").alias("assignments"), F.count_if(F.size("reasons") == 0).alias("valid"), F.count_if(F.array_contains("reasons", "unknown_variant")).alias("invalid_variants")),
        valid.agg(F.count_if(F.col("exposure_ts").isNull()).alias("missing_exposures")), ratios.agg(F.count_if(F.col("statistic") > max_ratio).alias("ratio_findings")),
        rows.agg(F.count_if(F.least("control_n", "treatment_n") < 2).alias("small_samples")), segments.agg(F.count_if(F.col("status") == "suppressed").alias("suppressed_segments")),
        guards.agg(F.count_if(F.col("status") == "fail").alias("guardrail_failures")), decided.agg(F.count_if(F.col("decision") == "invalid_experiment").alias("blocked")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out.withColumn("status", F.when(F.col("blocked") > 0, "failed").when(F.col("ratio_findings") + F.col("small_samples") + F.col("suppressed_segments") > 0, "passed_with_warnings").otherwise("passed"))


def broken_outputs(tests: DataFrame, binary: list[str]) -> DataFrame:
    """(experiment, metric, rule) of tested effects that can't be."""
    rules = F.array(
        F.when(~F.col("p_value").between(0, 1), F.lit("P_RANGE")), F.when(~F.col("adjusted_p").between(0, 1), F.lit("ADJUSTED_P_RANGE")), F.when(F.col("adjusted_p") < F.col("p_value"), F.lit("ADJUSTED_BELOW_P")), F.when(F.col("low") > F.col("high"), F.lit("INTERVAL_ORDER")),
        F.when(F.col("metric").isin(binary) & ~(F.col("control_value").between(0, 1) & F.col("treatment_value").between(0, 1)), F.lit("RATE_RANGE")),
    )
    return tests.select("experiment", "metric", F.explode(F.array_compact(rules)).alias("rule"))


def counts(rows: DataFrame) -> DataFrame:
    got = rows.groupBy("experiment", "population", "variant").agg(F.count("*").alias("users"))
    total = rows.groupBy("experiment", "population").agg(F.count("*").alias("all"))
    return got.join(total, ["experiment", "population"]).select("experiment", "population", "variant", "users", rate("users", "all").alias("share"))
