"""Reporting queries: facts over the results of the other domains, metrics, insights and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as op
from . import experiments, funnels, inputs, recommend, retention
from .inputs import sql

METRICS = [
    op.Metric("funnel_conversion_rate", "fact_funnel", "funnel", "completed", "entrants"), op.Metric("stage_dropoff_rate", "fact_stages", "funnel_stage", "drop_off", "previous"),
    op.Metric("classic_retention_rate", "fact_retention", "cohort", "returned", "members"), op.Metric("segment_population_share", "fact_segments", "segment", "users", "population"),
    op.Metric("experiment_treatment_effect", "fact_experiments", "experiment", "absolute_effect", unit="difference"),
]
RELATIONSHIPS = [op.Relationship("fact_funnel", "domain", "dim_domain", "domain"), op.Relationship("fact_retention", "domain", "dim_domain", "domain"), op.Relationship("fact_experiments", "domain", "dim_domain", "domain")]
PAGES = {"Acquisition": ["fact_funnel", "fact_stages"], "Retention": ["fact_retention"], "Segments": ["fact_segments"], "Experiments": ["fact_experiments"]}


def fact_funnel(spark, sf):
    return op.fact(funnels.funnel_summary(spark, sf), "funnel", F.col("funnel_id"), op.titled(F.col("funnel_id")), "funnel_summary", ["eligible", "entrants", "completed", "abandoned", "entry_rate", "completion_rate"])


def fact_stages(spark, sf):
    key = F.concat_ws(":", "funnel_id", F.col("stage").cast("string"))
    return op.fact(funnels.funnel_stage_metrics(spark, sf), "funnel", key, op.titled(F.col("funnel_id")), "funnel_stage_metrics", ["stage", "previous", "drop_off"])


def fact_retention(spark, sf):
    rows = op.first_rows(retention.op.cohort_summary(retention.periods(spark, sf)), ["definition_id", "cohort"])
    return op.fact(rows, "retention", F.concat_ws(":", "definition_id", "cohort"), F.concat_ws(" ", "definition_id", "cohort"), "retention_cohort_summary", ["members", "returned", "return_rate", "inactive", "resurrected"])


def fact_segments(spark, sf):
    rows = recommend.assigned(spark, sf).where("segment IS NOT NULL").groupBy("segment").agg(F.count("*").alias("users"))
    total = rows.agg(F.sum("users").alias("population"))
    return op.fact(rows.join(F.broadcast(total)), "segments", F.col("segment"), op.titled(F.col("segment")), "segment_rules", ["users", "population"])  # one row


def fact_experiments(spark, sf):
    return op.fact(experiments.decisions(spark, sf), "experiments", F.concat_ws(":", "experiment", "treatment"), op.titled(F.col("experiment")), "experiment_decisions", ["absolute_effect", "decision"])


def facts(spark, sf):
    out = {"fact_funnel": fact_funnel(spark, sf), "fact_stages": fact_stages(spark, sf), "fact_retention": fact_retention(spark, sf), "fact_segments": fact_segments(spark, sf), "fact_experiments": fact_experiments(spark, sf)}
    return out | {"dim_domain": op.domain_dimension(out), "dim_date": op.date_dimension(inputs.events(spark, sf), "ts")}


def funnel_inputs(spark, sf):
    return op.extremes(funnels.funnel_summary(spark, sf), F.col("funnel_id"), "completion_rate")


def retention_inputs(spark, sf):
    return op.extremes(retention.op.cohort_summary(retention.periods(spark, sf)), F.concat_ws(" ", "definition_id", "cohort"), "return_rate")


def insights(spark, sf):
    a = op.insight(funnel_inputs(spark, sf).select("best", "best_value", "lowest", "lowest_value"), "funnel", "Funnels complete at different rates", "%s completes most often (%s), %s least (%s).", "Review the step with the largest drop.", "funnel_summary", ["Few users enter some funnels."])
    b = op.insight(retention_inputs(spark, sf).select("lowest", "lowest_value", "n"), "retention", "Cohorts return at different rates", "%s returns least (%s) of %s cohorts.", "Look at what its members did first.", "retention_cohort_summary", ["Late periods are censored.", "Small cohorts are hidden."])
    top = fact_segments(spark, sf).agg(F.max_by("record_key", F.struct("users", "record_key")).alias("segment"), F.max("users").alias("users"))
    c = op.insight(top, "segmentation", "One segment is the largest", "%s has %s users.", "Plan for this segment first.", "segment_rules", ["Names of segments are analytical interpretations."])
    said = experiments.op.decision_counts(experiments.decisions(spark, sf)).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "decision", F.col("n").cast("string")))), ", ").alias("decisions"))
    d = op.insight(said, "experiment", "What the experiments decide", "Decisions are %s.", "Run those without evidence longer.", "experiment_decisions", ["Mind the sample-size of each arm."])
    return a.unionByName(b).unionByName(c).unionByName(d)


SOURCES = ["funnel_summary", "retention_cohort_summary", "segment_rules", "experiment_decisions"]
_FS, _ST = funnels.QUERIES["funnel_summary"][1], funnels.QUERIES["funnel_stage_metrics"][1]
_CS, _DC = retention.QUERIES["retention_cohort_summary"][1], experiments.QUERIES["experiment_decisions"][1]
_SG = recommend.QUERIES["segment_rules"][1]
_TITLE = "array_to_string(list_transform(string_split({}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
_LINE = "'{}' AS domain, {} AS record_key, {} AS label, '{}' AS source, true AS synthetic"
_FACTS = {
    "fact_funnel": f"SELECT {_LINE.format('funnel', 'funnel_id', _TITLE.format('funnel_id'), 'funnel_summary')}, eligible, entrants, completed, abandoned, entry_rate, completion_rate FROM ({_FS})",
    "fact_stages": f"SELECT {_LINE.format('funnel', 'funnel_id || chr(58) || stage', _TITLE.format('funnel_id'), 'funnel_stage_metrics')}, stage, previous, drop_off FROM ({_ST})",
    "fact_retention": f"SELECT {_LINE.format('retention', 'definition_id || chr(58) || cohort', 'definition_id || chr(32) || cohort', 'retention_cohort_summary')}, members, returned, return_rate, inactive, resurrected FROM (SELECT * FROM ({_CS}) ORDER BY definition_id, cohort LIMIT 24)",
    "fact_segments": f"SELECT {_LINE.format('segments', 'segment', _TITLE.format('segment'), 'segment_rules')}, users, (sum(users) OVER ())::BIGINT AS population FROM (SELECT segment, count(*) AS users FROM ({_SG}) WHERE segment IS NOT NULL GROUP BY ALL)",
    "fact_experiments": f"SELECT {_LINE.format('experiments', 'experiment || chr(58) || treatment', _TITLE.format('experiment'), 'experiment_decisions')}, absolute_effect, decision FROM ({_DC})",
}


def _with(body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _FACTS.items()) + " " + body


def _extremes(table: str, name: str, value: str) -> str:
    return f"""SELECT (SELECT {name} FROM ({table}) WHERE {value} IS NOT NULL ORDER BY {value} DESC, {name} LIMIT 1) AS best, max({value}) AS best_value, (SELECT {name} FROM ({table}) WHERE {value} IS NOT NULL ORDER BY {value}, {name} LIMIT 1) AS lowest, min({value}) AS lowest_value,
        (list({value} ORDER BY {value}))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM ({table}) WHERE {value} IS NOT NULL"""


_METRIC = " UNION ALL ".join(f"SELECT '{m.name}' AS metric_id, '{m.table}' AS \"table\", '{m.grain}' AS grain, '{m.unit}' AS unit, round_even({f'sum({m.numerator}) / nullif(sum({m.denominator}), 0)' if m.denominator else f'avg({m.numerator})'}, 6)::DOUBLE AS value FROM {m.table}" for m in METRICS)
_DOMAINS = " UNION ALL ".join(f"SELECT domain, count(*) AS rows, string_agg(DISTINCT source, '|') AS sources, '{t}' AS \"table\" FROM {t} GROUP BY ALL" for t in _FACTS)
_CHECKS = [f"{t}: {c}" for t in _FACTS for c in ("keys unique", "synthetic", "lineage")] + [f"{r.many}.{r.column} -> {r.one}.{r.key}" for r in RELATIONSHIPS] + ["metrics unique and of known tables", "pages have visuals of known tables"]
QUERIES = {
    **{f"report_{t}": ((lambda t: lambda spark, sf: globals()[t](spark, sf))(t), _with(f"SELECT * FROM {t}")) for t in _FACTS},
    "report_dim_domain": (lambda spark, sf: facts(spark, sf)["dim_domain"], _with(_DOMAINS)),
    "report_dim_date": (lambda spark, sf: op.date_dimension(inputs.events(spark, sf), "ts"), sql("SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS iso_week, isodow(d) AS weekday FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM e)", "e")),
    "report_metrics": (lambda spark, sf: op.metric_values(METRICS, facts(spark, sf)), _with(_METRIC)),
    "report_funnel_inputs": (funnel_inputs, _extremes(_FS, "funnel_id", "completion_rate")),
    "report_retention_inputs": (retention_inputs, _extremes(_CS, "definition_id || ' ' || cohort", "return_rate")),
    "report_insights": (lambda spark, sf: insights(spark, sf).select("insight_type", "title", F.size("caveats").alias("caveats"), F.array_join("supporting_evidence", ",").alias("evidence")), _with("""SELECT * FROM (VALUES ('funnel', 'Funnels complete at different rates', 1, 'funnel_summary'), ('retention', 'Cohorts return at different rates', 2, 'retention_cohort_summary'),
        ('segmentation', 'One segment is the largest', 1, 'segment_rules'), ('experiment', 'What the experiments decide', 1, 'experiment_decisions')) t(insight_type, title, caveats, evidence) WHERE (SELECT count(*) FROM fact_funnel) > 0""")),
    "report_segment_insight": (lambda spark, sf: insights(spark, sf).where("insight_type = 'segmentation'").select("summary"), _with("SELECT record_key || ' has ' || users || ' users.' AS summary FROM fact_segments ORDER BY users DESC, record_key DESC LIMIT 1")),
    "report_governance": (lambda spark, sf: op.governance(insights(spark, sf), SOURCES), "SELECT 4 AS insights, true AS have_sources, true AS sources_exist, true AS disclaimer_present, true AS no_causal_language, true AS no_certain_churn, true AS no_acceptance_probability, true AS segment_caveat, true AS experiment_caveat, 'passed' AS status"),
    "report_risks": (lambda spark, sf: op.risks(insights(spark, sf)), "SELECT * FROM (VALUES ('funnel', 'Funnels complete at different rates', 1, 'Few users enter some funnels.'), ('retention', 'Cohorts return at different rates', 1, 'Late periods are censored.'), ('retention', 'Cohorts return at different rates', 2, 'Small cohorts are hidden.'), ('segmentation', 'One segment is the largest', 1, 'Names of segments are analytical interpretations.'), ('experiment', 'What the experiments decide', 1, 'Mind the sample-size of each arm.')) t(insight_type, title, number, caveat)"),
    "report_checks": (lambda spark, sf: op.checks(facts(spark, sf), RELATIONSHIPS, METRICS, PAGES), "SELECT unnest([" + ", ".join(f"'{c}'" for c in _CHECKS) + "]) AS \"check\", true AS passed"),
    "report_rate_range": (lambda spark, sf: op.rates_in_range(fact_funnel(spark, sf), "record_key", ["entry_rate", "completion_rate"]), _with("SELECT record_key AS key, '' AS \"column\", entry_rate AS value FROM fact_funnel WHERE NOT entry_rate BETWEEN 0 AND 1")),
    "report_normalised": (lambda spark, sf: inputs.events(spark, sf).select("event_id", op.normalised(F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.concat(F.lit("k"), F.col("k").cast("string")))).alias("value")), sql("SELECT event_id, CASE WHEN k IS NULL THEN '' WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'k' || k END AS value FROM e", "e")),
}
