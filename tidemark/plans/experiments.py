"""Experiment queries: users dealt by their number, outcomes from events, and the reporting layer over results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import safe_div
from ..operators import experiments as op
from . import churn, funnels, inputs, recommend, retention
from .inputs import sql

VARIANTS = {"exp_layout": ["control", "treatment"], "exp_price": ["control", "treatment"]}
METRICS = {
    "converted": "max(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END)", "clicks": "count(CASE WHEN event_name = 'click' THEN 1 END)",
    "spend": "sum(CASE WHEN event_name = 'purchase' THEN value ELSE 0 END)", "errors": "count(CASE WHEN event_name = 'error' THEN 1 END)",
}
BINARY, DAYS, EXPOSURE_DAYS = ["converted"], 3, 2
GUARDRAILS = {"errors": ("decrease", 0.02, True), "clicks": ("increase", 0.5, False)}


def raw(spark, sf):
    """Two experiments over all users; some assignments have variants or times that can't be."""
    people = inputs.users(spark, sf).select("user_id", "signup_ts")
    arm = lambda n: F.when(F.col("user_id") % 37 == 5, "unknown").when(F.floor(F.col("user_id") / n) % 2 == 0, "control").otherwise("treatment")
    rows = None
    for name, n in (("exp_layout", 1), ("exp_price", 3)):
        one = people.select(F.lit(name).alias("experiment"), "user_id", arm(n).alias("variant"), F.col("signup_ts").alias("assigned_ts"), F.when(F.col("user_id") % 29 == 3, (F.col("signup_ts") - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")).alias("exposure_ts"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def judged(spark, sf):
    return op.integrity(raw(spark, sf), inputs.users(spark, sf), VARIANTS)


def valid(spark, sf):
    return op.exposed(judged(spark, sf).where(F.size("reasons") == 0), inputs.events(spark, sf), ["view"], EXPOSURE_DAYS)


def population(spark, sf):
    return op.populations(valid(spark, sf))


def values(spark, sf):
    return op.outcomes(population(spark, sf), inputs.events(spark, sf), METRICS, DAYS)


def effects(spark, sf):
    return op.effects(op.arms(values(spark, sf), "control"), BINARY)


def ratios(spark, sf):
    return op.ratio_check(valid(spark, sf), {"control": 0.5, "treatment": 0.5})


def guards(spark, sf):
    return op.guardrails(effects(spark, sf), GUARDRAILS)


def primary(spark, sf):
    return effects(spark, sf).where("population = 'intention_to_treat' AND metric = 'converted'")


def tests(spark, sf):
    return op.tested(effects(spark, sf))


def p_values(spark, sf):
    return tests(spark, sf).select("experiment", "population", "metric", "treatment", "p_value", "adjusted_p")


def segments(spark, sf):
    return op.segment_effects(values(spark, sf), inputs.users(spark, sf), ["persona", "region", "is_team"], "converted", "control", 8)


def decisions(spark, sf, excluded=True):
    rows = tests(spark, sf).where("population = 'intention_to_treat' AND metric = 'converted'")
    bad = judged(spark, sf).where(F.size("reasons") > 0)
    return op.decisions(rows, guards(spark, sf), ratios(spark, sf), bad if excluded else bad.limit(0), 0.05, power(spark, sf))


def power(spark, sf):
    return primary(spark, sf).where("control_value > 0").select("experiment", "control_value", stats.sample_size(F.col("control_value"), 0.05).alias("users_per_arm"))


def product_health(spark, sf):
    """The mean of funnel completion, mean cohort return and ranking quality."""
    a = funnels.funnel_summary(spark, sf).agg(F.avg("completion_rate").alias("completion"))
    b = retention.op.cohort_summary(retention.periods(spark, sf)).agg(F.avg("return_rate").alias("back"))
    c = recommend.op.averages(recommend.op.list_measures(recommend.ranked(spark, sf), recommend.held_out(spark, sf), recommend.K)).select("ndcg")
    rows = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    return rows.select(F.bround("completion", 6).alias("completion"), F.bround("back", 6).alias("back"), "ndcg", F.bround((F.bround("completion", 6) + F.bround("back", 6) + F.col("ndcg")) / 3, 6).alias("health"))


_A = """SELECT experiment, user_id, variant, signup_ts AS assigned_ts, exposure_ts, list_filter([CASE WHEN variant = 'unknown' THEN 'unknown_variant' END, CASE WHEN exposure_ts < signup_ts THEN 'exposed_before_assignment' END], lambda x: x IS NOT NULL) AS reasons FROM (
    SELECT experiment, user_id, signup_ts, CASE WHEN user_id % 37 = 5 THEN 'unknown' WHEN (user_id // n) % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, CASE WHEN user_id % 29 = 3 THEN signup_ts - INTERVAL 1 HOUR END AS exposure_ts
    FROM u, (VALUES ('exp_layout', 1), ('exp_price', 3)) t(experiment, n))"""
_V = f"SELECT experiment, user_id, variant, assigned_ts, (SELECT min(ts) FROM e WHERE e.user_id = a.user_id AND event_name = 'view' AND ts BETWEEN a.assigned_ts AND a.assigned_ts + INTERVAL {EXPOSURE_DAYS} DAY) AS exposure_ts FROM a WHERE len(reasons) = 0"
_P = "SELECT experiment, 'intention_to_treat' AS population, user_id, variant, assigned_ts AS basis_ts FROM v UNION ALL SELECT experiment, 'exposed', user_id, variant, exposure_ts FROM v WHERE exposure_ts IS NOT NULL"
_W = f"""SELECT experiment, population, variant, user_id, count(*) FILTER (event_name = 'purchase') > 0 AS converted, count(*) FILTER (event_name = 'click') AS clicks, coalesce(sum(value) FILTER (event_name = 'purchase'), 0) AS spend,
    count(*) FILTER (event_name = 'error') AS errors FROM p LEFT JOIN (SELECT user_id AS uid, ts, event_name, value FROM e) ON uid = user_id AND ts BETWEEN basis_ts AND basis_ts + INTERVAL {DAYS} DAY GROUP BY ALL"""
_O = " UNION ALL ".join(f"SELECT experiment, population, variant, user_id, '{m}' AS metric, {m}::INT::DOUBLE AS value FROM w" if m == "converted" else f"SELECT experiment, population, variant, user_id, '{m}', {m}::DOUBLE FROM w" for m in METRICS)
_S = """SELECT c.experiment, c.population, c.metric, t.variant AS treatment, c.n AS cn, c.s AS cs, c.m AS cm, c.v AS cv, t.n AS tn, t.s AS ts, t.m AS tm, t.v AS tv FROM ar c JOIN ar t ON (c.experiment, c.population, c.metric) = (t.experiment, t.population, t.metric) AND c.variant = 'control' AND t.variant <> 'control'"""
_E = """SELECT experiment, population, metric, treatment, cn AS control_n, tn AS treatment_n, round_even(cm, 6) AS control_value, round_even(tm, 6) AS treatment_value, round_even(tm - cm, 6) AS absolute_effect, coalesce(round_even((tm - cm) / nullif(cm, 0), 6), 0) AS relative_effect,
    round_even(se, 6) AS standard_error, coalesce(round_even((tm - cm) / nullif(se, 0), 6), 0) AS statistic, CASE WHEN metric = 'converted' THEN 0 ELSE coalesce(round_even((cv / cn + tv / tn) * (cv / cn + tv / tn) / nullif((cv / cn) * (cv / cn) / nullif(cn - 1, 0) + (tv / tn) * (tv / tn) / nullif(tn - 1, 0), 0), 6), 0) END AS degrees FROM (
    SELECT *, CASE WHEN metric = 'converted' THEN sqrt(((cs + ts) / (cn + tn)) * (1 - (cs + ts) / (cn + tn)) * ((cn + tn) / (cn * tn))) ELSE sqrt(cv / cn + tv / tn) END AS se FROM si)"""
_R = "SELECT *, round_even((c - n * 0.5::DOUBLE) * (c - n * 0.5::DOUBLE) / (n * 0.5::DOUBLE) + (t - n * 0.5::DOUBLE) * (t - n * 0.5::DOUBLE) / (n * 0.5::DOUBLE), 6) AS statistic FROM (SELECT experiment, count(*) AS n, count(*) FILTER (variant = 'control') AS c, count(*) FILTER (variant = 'treatment') AS t FROM v GROUP BY ALL)"
_G = "SELECT experiment, treatment, metric, absolute_effect, CASE WHEN metric = 'errors' THEN absolute_effect > 0.02 ELSE -absolute_effect > 0.5 END AS harmed, CASE WHEN metric = 'errors' AND absolute_effect > 0.02 THEN 'fail' ELSE 'pass' END AS status FROM ef WHERE population = 'intention_to_treat' AND metric IN ('errors', 'clicks')"
_ALL = {"a": _A, "v": _V, "p": _P, "w": _W, "o": _O, "ar": "SELECT experiment, population, metric, variant, count(*) AS n, sum(value) AS s, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM o GROUP BY ALL", "si": _S, "ef": _E, "rt": _R, "gd": _G}
_SIMPSON = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {}))"
_NORMAL_P = f"greatest(0, 1 - 2 / sqrt(2 * pi()) * abs(statistic) / 6000 * {_SIMPSON.format('exp(-pow(abs(statistic) * i / 2000, 2) / 2)')})"
_T_P = f"greatest(0, 1 - 2 * exp(lgamma((degrees + 1) / 2) - lgamma(degrees / 2)) / sqrt(degrees * pi()) * abs(statistic) / 6000 * {_SIMPSON.format('pow(1 + pow(abs(statistic) * i / 2000, 2) / degrees, -(degrees + 1) / 2)')})"
_ALL["pv"] = f"""SELECT experiment, population, metric, treatment, control_n, treatment_n, absolute_effect, control_value, p_value, round_even(least(min(p_value * m / r) OVER (PARTITION BY experiment, population ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS adjusted_p FROM (
    SELECT *, count(*) OVER (PARTITION BY experiment, population) AS m, row_number() OVER (PARTITION BY experiment, population ORDER BY p_value) AS r FROM (SELECT *, round_even(CASE WHEN degrees > 0 THEN {_T_P} ELSE {_NORMAL_P} END, 6) AS p_value FROM ef))"""
_POWER = "ceil({}::DOUBLE * 2 * control_value * (1 - control_value) / (0.05::DOUBLE * 0.05::DOUBLE))::BIGINT".format(repr((stats.NORMAL.inv_cdf(0.975) + stats.NORMAL.inv_cdf(0.8)) ** 2))
_BAD = "(ratio > 6.634897 OR excluded > 0)"
_ENOUGH = "least(control_n, treatment_n) >= coalesce(needed, 0)"
_ALL["dc"] = f"""SELECT experiment, treatment, absolute_effect, adjusted_p, ratio, failed, excluded,
    CASE WHEN {_BAD} THEN 'invalid_experiment' WHEN failed > 0 THEN 'do_not_ship' WHEN absolute_effect < -0.05 AND adjusted_p < 0.05 THEN 'do_not_ship' WHEN absolute_effect >= 0.05 AND adjusted_p < 0.05 AND {_ENOUGH} THEN 'ship' WHEN absolute_effect >= 0.05 AND {_ENOUGH} THEN 'ship_with_caution'
         WHEN absolute_effect >= 0.05 THEN 'continue_experiment' ELSE 'no_clear_evidence' END AS decision,
    CASE WHEN {_BAD} THEN 'integrity_or_srm_blocker' WHEN failed > 0 THEN 'critical_guardrail_harm' WHEN absolute_effect < -0.05 AND adjusted_p < 0.05 THEN 'primary_metric_degradation' WHEN absolute_effect >= 0.05 AND adjusted_p < 0.05 AND {_ENOUGH} THEN 'statistical_and_practical_primary_lift'
         WHEN absolute_effect >= 0.05 AND {_ENOUGH} THEN 'practical_lift_without_full_statistical_confidence' WHEN absolute_effect >= 0.05 THEN 'promising_underpowered_effect' ELSE 'primary_metric_not_statistically_or_practically_clear' END AS reason FROM (
    SELECT q.*, rt.statistic AS ratio, CASE WHEN control_value > 0 THEN {_POWER} END AS needed, (SELECT count(*) FROM gd WHERE gd.experiment = q.experiment AND gd.treatment = q.treatment AND status = 'fail') AS failed, (SELECT count(*) FROM a WHERE a.experiment = q.experiment AND len(reasons) > 0) AS excluded
    FROM (SELECT * FROM pv WHERE population = 'intention_to_treat' AND metric = 'converted') q JOIN rt USING (experiment))"""
_ALL["sg"] = " UNION ALL ".join(f"""SELECT *, CASE WHEN least(control_n, treatment_n) < 8 THEN 'suppressed' ELSE 'shown' END AS status FROM (SELECT experiment, '{d}' AS dimension, {d}::VARCHAR AS value, 'treatment' AS treatment, count(*) FILTER (variant = 'control') AS control_n, count(*) FILTER (variant = 'treatment') AS treatment_n,
    coalesce(sum(w.converted::INT) FILTER (variant = 'control'), 0) AS cs, coalesce(sum(w.converted::INT) FILTER (variant = 'treatment'), 0) AS ts FROM w JOIN u USING (user_id) WHERE population = 'intention_to_treat' GROUP BY ALL) WHERE treatment_n > 0""" for d in ("persona", "region", "is_team"))
_PRIMARY = "SELECT * FROM ef WHERE population = 'intention_to_treat' AND metric = 'converted'"


def _over(body: str, *names: str) -> str:
    return sql(body, "e", "u", **{k: _ALL[k] for k in names or _ALL})


_EF = ("a", "v", "p", "w", "o", "ar", "si", "ef")
QUERIES = {
    "experiment_integrity": (lambda spark, sf: judged(spark, sf).select("experiment", "user_id", "variant", F.array_join("reasons", "|").alias("reasons")), _over("SELECT experiment, user_id, variant, array_to_string(reasons, '|') AS reasons FROM a", "a")),
    "experiment_exposure": (lambda spark, sf: valid(spark, sf).select("experiment", "user_id", "variant", "assigned_ts", "exposure_ts"), _over("SELECT * FROM v", "a", "v")),
    "experiment_population": (lambda spark, sf: op.counts(population(spark, sf)), _over("SELECT *, round_even(users / sum(users) OVER (PARTITION BY experiment, population), 6) AS share FROM (SELECT experiment, population, variant, count(*) AS users FROM p GROUP BY ALL)", "a", "v", "p")),
    "experiment_outcomes": (values, _over("SELECT * FROM o", "a", "v", "p", "w", "o")),
    "experiment_srm_stat": (lambda spark, sf: ratios(spark, sf), _over("SELECT experiment, n, c AS n_control, t AS n_treatment, statistic, 1 AS degrees FROM rt", "a", "v", "rt")),
    "experiment_srm_p": (lambda spark, sf: ratios(spark, sf).select("experiment", "statistic", F.bround(stats.chi2_p("statistic", "degrees"), 6).alias("p_value")), _over(f"SELECT experiment, chi AS statistic, round_even({_NORMAL_P}, 6) AS p_value FROM (SELECT experiment, statistic AS chi, sqrt(statistic) AS statistic FROM rt)", "a", "v", "rt")),
    "experiment_metric_effects": (effects, _over("SELECT * FROM ef", *_EF)),
    "experiment_tests": (lambda spark, sf: op.tested(effects(spark, sf)), None),
    "experiment_bh_adjust": (p_values, _over("SELECT experiment, population, metric, treatment, p_value, adjusted_p FROM pv", *_EF, "pv")),
    "experiment_statuses": (lambda spark, sf: op.statuses(op.roles(tests(spark, sf), "converted", list(GUARDRAILS)), {"converted": ("increase", 0.05), "errors": ("decrease", 0.02)}).select("experiment", "population", "metric", "treatment", "role", "significance", "practical", "quality"), _over("""
        SELECT experiment, population, metric, treatment, CASE metric WHEN 'converted' THEN 'primary' WHEN 'spend' THEN 'secondary' ELSE 'guardrail' END AS role, CASE WHEN adjusted_p < 0.05 THEN 'significant' ELSE 'not_significant' END AS significance,
        CASE WHEN CASE metric WHEN 'converted' THEN absolute_effect >= 0.05 WHEN 'errors' THEN -absolute_effect >= 0.02 ELSE absolute_effect >= 0 END THEN 'met' ELSE 'not_met' END AS practical, CASE WHEN least(control_n, treatment_n) = 0 THEN 'zero_denominator' WHEN least(control_n, treatment_n) < 2 THEN 'small_sample_warning' ELSE 'ok' END AS quality FROM pv""", *_EF, "pv")),
    "experiment_segment_effects": (segments, _over("""SELECT experiment, dimension, value, treatment, control_n, treatment_n, status, CASE WHEN status = 'shown' THEN round_even(ts / treatment_n - cs / control_n, 6) END AS absolute_effect,
        CASE WHEN status = 'shown' THEN coalesce(round_even((ts / treatment_n - cs / control_n) / nullif(sqrt(((cs + ts) / (control_n + treatment_n)) * (1 - (cs + ts) / (control_n + treatment_n)) * ((control_n + treatment_n) / (control_n * treatment_n))), 0), 6), 0) END AS statistic FROM sg""", "a", "v", "p", "w", "sg")),
    "experiment_selected": (lambda spark, sf: op.selected(raw(spark, sf), VARIANTS, ["exp_price"]).select("experiment", "user_id", "variant"), _over("SELECT experiment, user_id, variant FROM a WHERE experiment = 'exp_price'", "a")),
    "experiment_guardrail_summary": (lambda spark, sf: op.guardrail_summary(guards(spark, sf)), _over("SELECT experiment, treatment, CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'passed' ELSE 'failed ' || string_agg(metric, ', ' ORDER BY metric) FILTER (status = 'fail') END AS guardrails FROM gd GROUP BY ALL", *_EF, "gd")),
    "experiment_decision_counts": (lambda spark, sf: op.decision_counts(decisions(spark, sf)), _over("SELECT decision, count(*) AS n FROM dc GROUP BY ALL", *_EF, "gd", "rt", "pv", "dc")),
    "experiment_diagnostics": (lambda spark, sf: op.diagnostics(judged(spark, sf), valid(spark, sf), effects(spark, sf), ratios(spark, sf), segments(spark, sf), guards(spark, sf), decisions(spark, sf)), _over("""
        SELECT *, CASE WHEN blocked > 0 THEN 'failed' WHEN ratio_findings + small_samples + suppressed_segments > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM (SELECT count(*) AS assignments, count(*) FILTER (len(reasons) = 0) AS valid, count(*) FILTER (list_contains(reasons, 'unknown_variant')) AS invalid_variants,
        (SELECT count(*) FROM v WHERE exposure_ts IS NULL) AS missing_exposures, (SELECT count(*) FROM rt WHERE statistic > 6.634897) AS ratio_findings, (SELECT count(*) FROM ef WHERE least(control_n, treatment_n) < 2) AS small_samples,
        (SELECT count(*) FROM sg WHERE status = 'suppressed') AS suppressed_segments, (SELECT count(*) FROM gd WHERE status = 'fail') AS guardrail_failures, (SELECT count(*) FROM dc WHERE decision = 'invalid_experiment') AS blocked FROM a)""", *_EF, "gd", "rt", "pv", "dc", "sg")),
    "experiment_output_checks": (lambda spark, sf: op.broken_outputs(tests(spark, sf), BINARY), _over("SELECT experiment, metric, '' AS rule FROM pv WHERE NOT p_value BETWEEN 0 AND 1", *_EF, "pv")),
    "experiment_guardrails": (guards, _over("SELECT * FROM gd", *_EF, "gd")),
    "experiment_power": (power, _over(f"SELECT experiment, control_value, ceil({(stats.NORMAL.inv_cdf(0.975) + stats.NORMAL.inv_cdf(0.8)) ** 2!r}::DOUBLE * 2 * control_value * (1 - control_value) / (0.05::DOUBLE * 0.05::DOUBLE))::BIGINT AS users_per_arm FROM ({_PRIMARY}) WHERE control_value > 0", *_EF)),
    "experiment_decisions": (lambda spark, sf: decisions(spark, sf).withColumn("reason", F.array_join("reason_codes", "|")).drop("reason_codes"), _over("SELECT * FROM dc", *_EF, "gd", "rt", "pv", "dc")),
    "report_product_health": (product_health, f"""SELECT completion, back, ndcg, round_even((completion + back + ndcg) / 3, 6) AS health FROM (SELECT (SELECT round_even(avg(completion_rate), 6) FROM ({funnels.QUERIES['funnel_summary'][1]})) AS completion,
        (SELECT round_even(avg(return_rate), 6) FROM ({retention.QUERIES['retention_cohort_summary'][1]})) AS back, (SELECT ndcg FROM ({recommend.QUERIES['ranking_metrics_at_k'][1]})) AS ndcg)"""),
}
